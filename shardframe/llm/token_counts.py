"""Token counts by the whole-token shortcut.

Vocabulary strings that encode alone as one token are proved so once, on the driver, by encoding each; the proof (at most
the vocabulary's strings) is sent to the executors. A pre-token that is such a string counts 1 by a table look-up, and only
the other pre-tokens are merged by the library.

Defined cases: null text counts as empty (0 bytes, 0 tokens); each input row gives one row, repeated rows and null ids
included; an empty table gives no rows. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.bpe import Encoder
from shardframe.llm.common import texts


def whole_tokens(encode: Encoder) -> set[str]:
    """The vocabulary strings that encode alone as exactly their own token: proved by encoding each of them."""
    size = encode.library.get_vocab_size(with_added_tokens=False)
    strings = [encode.library.decode([i], skip_special_tokens=False) for i in range(size)]
    sound = [(i, s) for i, s in enumerate(strings) if s and "\ufffd" not in s]
    found = encode.library.encode_batch([s for _, s in sound], add_special_tokens=False)
    return {s for (i, s), e in zip(sound, found, strict=True) if e.ids == [i]}


class Counter(Encoder):
    """Counts tokens; whole holds the strings that are proved to be one token."""

    def __init__(self, name: str, whole: set[str]):
        super().__init__(name)
        self.whole = set() if self.lower else whole  # a text in lower case is not the vocabulary's string
        self.tables(self.cost)

    def cost(self, piece: str) -> int:
        """1 for a whole token; the library merges any other pre-token."""
        return 1 if piece in self.whole else len(self.piece(piece))

    def __call__(self, text: str) -> int:
        return sum(self.parts(text, lambda t: len(self.by_library(t)), lambda s: len(self.specials[s]), self.words, self.runs))


_proofs: dict[str, set[str]] = {}
_counters: dict[str, Counter] = {}


def proof(vocabulary: str) -> set[str]:
    if vocabulary not in _proofs:
        _proofs[vocabulary] = whole_tokens(Encoder(vocabulary))
    return _proofs[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(proof(vocabulary))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary, sent.value)
        counter = _counters[vocabulary]
        for b in batches:
            n = [counter(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
