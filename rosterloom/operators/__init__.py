"""DataFrame to DataFrame operators. Keys and ordinals are arguments; nothing is collected."""
