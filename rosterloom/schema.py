"""Struct types. Ordinals are explicit, because order is data; missing strings are
empty inside the engine and -1 in a verdict means "not asked"."""

from __future__ import annotations

PERIOD_POINT = "STRUCT<day: BIGINT, hour: BIGINT, minute: BIGINT>"
HOURS = f"STRUCT<weekday_descriptions: ARRAY<STRING>, periods: ARRAY<STRUCT<open: {PERIOD_POINT}, close: {PERIOD_POINT}>>, open_now: BOOLEAN>"
DETAILS = f"""STRUCT<place_id: STRING, formatted_address: STRING, phone_international: STRING, website: STRING,
  google_maps_url: STRING, rating: DOUBLE, user_rating_count: BIGINT, business_status: STRING, types: ARRAY<STRING>,
  opening_hours: {HOURS}, current_opening_hours: {HOURS}, photos: ARRAY<STRUCT<content_type: STRING, base64: STRING>>>"""
SOURCE_HOURS = f"STRUCT<weekdayDescriptions: ARRAY<STRING>, periods: ARRAY<STRUCT<open: {PERIOD_POINT}, close: {PERIOD_POINT}>>, openNow: BOOLEAN>"

OCR_LINES = "doc_id STRING, col_index INT, line_no INT, text STRING, confidence FLOAT, x0 INT, y0 INT, x1 INT, y1 INT"
LAYOUT_LINES = OCR_LINES + ", raw_text STRING, norm_text STRING"
PAGE_COLUMNS = "doc_id STRING, col_index INT, x0 INT, y0 INT, x1 INT, y1 INT"
CATALOG = f"ref_no INT, name STRING, address STRING, phone STRING, name_latin STRING, address_latin STRING, lat DOUBLE, lon DOUBLE, google {DETAILS}"
ENTRIES = "doc_id STRING, col_index INT, day_no INT, date DATE, day_name STRING, shift_no INT, from_time STRING, to_time STRING, entry_no INT, name STRING, address STRING, phone STRING"
SCHEDULE_IMAGES = "ord INT, url STRING, from_date DATE, to_date DATE"
IDENTITY_GROUPS = "group_no INT, name STRING, address STRING, phone STRING, candidates ARRAY<STRUCT<id: STRING, name: STRING, address: STRING, ref_no: INT>>"
IDENTITY_VERDICTS = "group_no INT, choice STRING, confidence DOUBLE, same DOUBLE, probabilities MAP<STRING, DOUBLE>"
PAIR_VERDICTS = "group_no INT, ref_index INT, candidate STRING, outcome STRING, score DOUBLE, confidence DOUBLE, same_name DOUBLE, same_address DOUBLE"
DECISIONS = "key STRING, choice_index INT, confidence DOUBLE, same DOUBLE, probabilities MAP<STRING, DOUBLE>, model STRING, decided_at STRING, name_plausible DOUBLE, address_plausible DOUBLE"
GOLDEN = f"""source STRUCT<name: STRING, phone: STRING>, matched BOOLEAN, placeId STRING, name STRING, phone STRING,
  phoneInternational STRING, websiteUrl STRING, googleMapsUrl STRING, formattedAddress STRING, latitude DOUBLE, longitude DOUBLE,
  timeZone STRING, utcOffsetMinutes BIGINT, rating DOUBLE, userRatingCount BIGINT, businessStatus STRING, types ARRAY<STRING>,
  openingHours {SOURCE_HOURS}, currentOpeningHours {SOURCE_HOURS}, photos ARRAY<STRUCT<contentType: STRING, base64: STRING>>"""
CACHE_EVENTS = "seq BIGINT, week_key STRING, sha STRING, fetched_at TIMESTAMP, payload STRING"
IMAGES = "image_id STRING, img STRUCT<data: BINARY, w: INT, h: INT>"
