"""Judgments: candidate groups, verdict gates, decision tables, offline judging.

A judge is any function from a DataFrame of groups to one of verdicts. None is
remote here; rule_judge decides by similarity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import checks, text
from rosterloom.operators.catalog import entry_label, top1

Judge = Callable[[DataFrame], DataFrame]

# --- fixed values: texts of warnings, in the order in which they are tried ---
FAILED = "phone %s matches several catalog entries and identity adjudication failed (%s); kept the similarity pick"
RETURNED = "phone %s matches several catalog entries and identity adjudication returned %d verdicts; kept the similarity pick"
NO_CANDIDATE = "phone %s matches several catalog entries; adjudicator found no confident candidate (confidence %.2f, same-pharmacy %.2f); kept the similarity pick"
UNKNOWN = 'phone %s matches several catalog entries and identity adjudication chose an unknown candidate "%s"; kept the similarity pick'
BELOW = "phone %s matches several catalog entries; adjudicator confidence %.2f / same-pharmacy %.2f below the gate; kept the similarity pick"
OVERRIDE = "phone %s matches several catalog entries; adjudicator selected %s instead of the similarity pick %s"
CHECK_FAILED = "plausibility verification failed for %d unmatched pharmacy entries (%s); the entries are unchanged"
CHECK_RETURNED = "plausibility verification returned %d verdicts for %d unmatched entries; skipped"
IMPLAUSIBLE = '%s is not in the catalog; %s "%s" reads implausibly (plausibility %.2f below %.2f) on %s'
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Gates:
    """Least confidences. A zero means the default, so gates cannot be switched off."""

    identity_confidence: float = 0.8
    identity_same: float = 0.8
    name: float = 0.5
    address: float = 0.7

    @classmethod
    def of(cls, **given: float) -> Gates:
        return cls(**{k: v for k, v in given.items() if v})


def identity_groups(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with more than one candidate, with these as c0, c1, ... in catalog order."""
    found = F.array_sort(F.collect_list(F.struct("ref_no", "ref_name", "ref_address")))
    groups = pairs.groupBy(*keys, "name", "address", "phone").agg(found.alias("_found")).where(F.size("_found") > 1)
    option = lambda c, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), c["ref_name"].alias("name"), c["ref_address"].alias("address"), c["ref_no"].alias("ref_no"))
    return groups.withColumn("candidates", F.transform("_found", option)).drop("_found")


def merge_pairs(refs: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """All pairs of references and records of one key, where either side has several."""
    left = refs.join(refs.groupBy(key).agg(F.count("*").alias("_l")), key)
    right = records.join(records.groupBy(key).agg(F.count("*").alias("_r")), key)
    return left.join(right, key).where((F.col("_l") > 1) | (F.col("_r") > 1)).drop("_l", "_r")


def best_outcome(verdicts: DataFrame, keys: list[str], outcome: str, score: str, ident: str) -> DataFrame:
    """same before curator before different, then the higher score, then the smaller id."""
    return verdicts.groupBy(*keys).agg(_least_verdict(verdicts, outcome, score, ident).alias("_b")).select("_b.v.*")


def _least_verdict(verdicts: DataFrame, outcome: str, score: str, ident: str) -> Column:
    rank = F.array_position(F.array(F.lit("same"), F.lit("curator"), F.lit("different")), F.col(outcome))
    return F.min(F.struct(rank.alias("r"), (-F.col(score)).alias("s"), F.col(ident).alias("i"), F.struct(*verdicts.columns).alias("v")))


def best_outcome_by_record(refs: DataFrame, records: DataFrame, key: str, keys: list[str], outcome: str, score: str, ident: str) -> DataFrame:
    """best_outcome of merge_pairs where outcome and score are the record's own,
    whichever reference it meets: the best record of a key is best for each of its
    references, so only that one meets them and no product is made."""
    top = records.groupBy(key).agg(F.count("*").alias("_r"), _least_verdict(records.drop(key), outcome, score, ident).alias("_b"))
    met = refs.join(refs.groupBy(key).agg(F.count("*").alias("_l")), key).join(top, key).where((F.col("_l") > 1) | (F.col("_r") > 1))
    return best_outcome(met.select(*refs.columns, "_b.v.*"), keys, outcome, score, ident)


def content_key(*inputs: Column | str, model: str, namespace: str = "") -> Column:
    """Key of a decision: digest of the model and the inputs without ids."""
    payload = F.to_json(F.struct(F.lit(model).alias("model"), F.struct(*inputs).alias("inputs")))
    return F.concat(F.lit(namespace), F.sha2(payload, 256))


def latest_decisions(decisions: DataFrame, key: str = "key", at: str = "decided_at") -> DataFrame:
    """One row per key: the last one put replaces those before it. Without a time
    of decision, the greatest row, so that a replay gives the same each time."""
    columns = [c for c in decisions.columns if c != key]
    # maps have no order; a key's rows of one time are told apart by the other columns
    ranked = [F.col(at)] * (at in columns) + [F.col(c) for c in columns if decisions.schema[c].dataType.typeName() != "map"]
    last = decisions.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(ranked)))).alias("_last"))
    return last.select(key, "_last.*").select(*decisions.columns)


def replay(asked: DataFrame, decisions: DataFrame, judge: Judge, key: str, usable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Known decisions and judged misses together, and the fresh ones to put.
    Only misses reach the judge, and equal questions are judged once. usable: a
    condition on stored rows; the others count as misses. Stored rows are raw, so
    gates apply at read time. The fresh ones are persisted: a judge is asked once,
    however often its answers are read."""
    stored = latest_decisions(decisions, key)
    stored = stored if usable is None else stored.where(usable)
    misses = asked.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    fresh = judge(misses).select(*stored.columns).persist()
    return asked.join(stored.unionByName(fresh), key), fresh


def stored_choice(choice: Column | str, ids: Column | str) -> Column:
    """A choice as its position in the candidate list, -1 for none."""
    choice = F.col(choice) if isinstance(choice, str) else choice
    return F.when(choice == "none", F.lit(-1)).otherwise((F.array_position(ids, choice) - 1).cast("int"))


def restored_choice(position: Column | str, ids: Column | str) -> Column:
    """The candidate at a stored position under its present id; none for -1, null (a miss) outside the list."""
    position = F.col(position) if isinstance(position, str) else position
    return F.when(position == -1, F.lit("none")).when(position >= 0, F.get(ids, position))


def judged_picks(groups: DataFrame, verdicts: DataFrame, picks: DataFrame, keys: list[str], gates: Gates) -> DataFrame:
    """The reference of each ambiguous entry: the judged one if its verdict passes
    the gates, otherwise the similarity pick with a reason. A judge that failed
    says why in a column error; other than one verdict is a reason, too. Columns:
    keys, ref_no, judged, warning (null where the judge agrees)."""
    named = picks.select(*keys, F.col("ref_no").alias("_sim"), F.col("ref_name").alias("_sim_name"))
    fields = [F.any_value(c).alias(c) for c in ("choice", "confidence", "same")]
    error = F.max("error") if "error" in verdicts.columns else F.lit(None).cast("string")
    counted = verdicts.groupBy(*keys).agg(F.count("*").alias("_n"), error.alias("_error"), *fields)
    joined = groups.join(named, keys).join(counted, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    chosen = F.get(F.filter("candidates", lambda c: c["id"] == F.col("choice")), F.lit(0))
    passes = checks.accept_identity("choice", "confidence", "same", gates.identity_confidence, gates.identity_same)
    reason = (
        F.when(F.col("_error").isNotNull(), F.format_string(FAILED, "phone", "_error"))
        .when(F.col("_n") != 1, F.format_string(RETURNED, "phone", "_n"))
        .when(F.col("choice") == "none", F.format_string(NO_CANDIDATE, "phone", "confidence", "same"))
        .when(chosen.isNull(), F.format_string(UNKNOWN, "phone", "choice"))
        .when(~passes, F.format_string(BELOW, "phone", "confidence", "same"))
    )
    override = F.when(chosen["ref_no"] != F.col("_sim"), F.format_string(OVERRIDE, "phone", chosen["name"], "_sim_name"))
    accepted = reason.isNull()
    return joined.select(*keys, F.when(accepted, chosen["ref_no"]).otherwise(F.col("_sim")).alias("ref_no"), accepted.alias("judged"), F.coalesce(reason, override).alias("warning"))


def plausibility_questions(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per field to judge: keys, field, value; empty fields are not asked about."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("name", "address")))
    return entries.select(*keys, F.explode(fields).alias("q")).select(*keys, "q.*").where("value <> ''")


def merge_questions(pairs: DataFrame, keys: list[str], name: str, address: str, ref_name: str, ref_address: str) -> DataFrame:
    """One row per question about a pair of records: how they relate, whether the
    names are the same, and the addresses where both are given."""
    kinds = F.array_compact(F.array(F.lit("link_state"), F.lit("same_name"), F.when((F.col(address) != "") & (F.col(ref_address) != ""), "same_address")))
    return pairs.select(*keys, name, address, ref_name, ref_address, F.explode(kinds).alias("question"))


def plausibility_warnings(entries: DataFrame, verdicts: DataFrame, keys: list[str], gates: Gates, failed: str | None = None) -> DataFrame:
    """One row per implausible field of entries (keys, name, address, phone, date):
    keys, field_no, warning. A judge that failed gives one warning, and so do
    verdicts that are more or fewer than the entries; both have null keys."""
    none = [F.lit(None).cast(entries.schema[k].dataType).alias(k) for k in keys]
    asked = entries.agg(F.count("*").alias("_asked")).where("_asked > 0")
    if failed is not None:
        return asked.select(*none, F.lit(0).alias("field_no"), F.format_string(CHECK_FAILED, "_asked", F.lit(failed)).alias("warning"))
    counts = asked.join(verdicts.agg(F.count("*").alias("_got")))
    odd = counts.where("_asked <> _got").select(*none, F.lit(0).alias("field_no"), F.format_string(CHECK_RETURNED, "_got", "_asked").alias("warning"))
    fields = F.transform(checks.implausible_fields("name_plausible", "address_plausible", gates.name, gates.address), lambda f: f)
    found = entries.join(verdicts.select(*keys, "name_plausible", "address_plausible"), keys).select("*", F.posexplode(fields).alias("field_no", "field"))
    is_name = F.col("field") == "name"
    value = F.when(is_name, F.col("name")).otherwise(F.col("address"))
    probability = F.when(is_name, F.col("name_plausible")).otherwise(F.col("address_plausible"))
    gate = F.when(is_name, F.lit(gates.name)).otherwise(F.lit(gates.address))
    text_of = F.format_string(IMPLAUSIBLE, entry_label(), "field", value, probability, gate, F.date_format("date", "dd/MM/yyyy"))
    even = found.join(F.broadcast(counts.where("_asked = _got")))
    return even.select(*keys, "field_no", text_of.alias("warning")).unionByName(odd)


def request_payload(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The groups as they are put to a judge, without code-side numbers."""
    shown = F.transform("candidates", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["address"].alias("address")))
    return groups.select(*keys, F.to_json(F.struct(F.struct("name", "address", "phone").alias("reading"), shown.alias("candidates"))).alias("payload"))


def rule_judge(groups: DataFrame, keys: list[str]) -> DataFrame:
    """An offline identity judge: the candidate most similar in name and address;
    confidence is its similarity, same the similarity of the addresses alone."""
    options = groups.select(*keys, "name", "address", F.explode("candidates").alias("c"))
    names = text.similarity(text.transliterate("name"), text.transliterate("c.name"))
    addresses = text.similarity(text.transliterate("address"), text.transliterate("c.address"))
    scored = options.select(*keys, F.col("c.id").alias("choice"), F.col("c.name").alias("_n"), ((names + addresses) / 2).alias("confidence"), addresses.alias("same"))
    best = top1(scored, keys, F.col("confidence"), ["_n", "choice"], out="_s")
    return best.select(*keys, "choice", "confidence", "same")
