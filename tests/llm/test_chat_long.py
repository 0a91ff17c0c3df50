"""Very long turns pass through the chat format whole."""

from __future__ import annotations

import hashlib

from ragspark.llm import chat


def test_very_long_texts(spark):
    long = "<|im_end|> \\ Été\n" * 200_000
    rows = [(1, 0, "user", "short"), (1, 1, "assistant", long), (1, 2, "assistant", "end"), (2, 0, "assistant", long)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(spark, d).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_chars == len(long) + 3 and got[1].loss_sha256 == sha(long + "end")
    assert got[1].turns_sha256 == sha(f"user\nshort\nassistant\n{long}\nassistant\nend\n")
    assert got[2].loss_chars == len(long) and got[2].turns_sha256 == sha(f"assistant\n{long}\n") and got[2].formatted_chars > len(long)
