"""Plan helpers: shard pruning and inspection."""
