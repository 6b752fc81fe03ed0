from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a user's table may hold beside, named like columns that operators use inside.
EXTRA = ("size", "rank", "kept", "key", "label", "row_id", "node", "line", "slot", "n", "digest", "host", "_id", "copies", "score")


@pytest.fixture
def docs(spark):
    """Makes documents from rows (doc_id, text[, lang[, source]]), with clashing extra columns."""

    def make(rows, extra=True):
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or ""))[:5] for r in rows]
        frame = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            for c in EXTRA:
                frame = frame.selectExpr("*", f"'x' as `{c}`")
        return frame

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empties, a very long text, ties, repeated rows, a null id."""
    words = " ".join(f"wort{i % 977}" for i in range(60_000))
    return [(1, "Hello world this is a text", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "no id here at all", "fr", "b"), (5, "same", "de", "b"), (6, "SAME", "de", "b"), (7, "same", "de", "b"), (7, "same", "de", "b"), (8, words, "en", "a"), (9, "  \n \n", "es", "c")]
