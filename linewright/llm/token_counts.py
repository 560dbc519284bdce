"""Token counts of whole texts by a public tokenizer; only the lengths leave a task.

Texts are cut into pieces of at most ``PIECE_BYTES`` and the pieces go to the library in
batches of about ``BATCH_BYTES``, so that a call holds the same amount of text whether
the documents are short or endless. A piece ends only where the tokenizer's own pattern
always ends a token: after an ASCII letter or digit that another kind of ASCII character
follows. No token and no special string has such a place inside, and the pattern looks at
nothing before a token's start, so the pieces' counts add up to the count of the whole
text. The rule is read off byte-level tokenizers without normalizer or added space; texts
of any other are not cut.

Defined cases: a null or empty text has no bytes and no tokens; a very long text is cut as
above, and goes whole only where it has no such place; special strings inside texts are
handled as the library does by default; a null ``doc_id`` and rows that are repeated are
counted row by row; an empty table gives no rows; columns besides ``doc_id`` and ``text``
are not read, whatever their names. There are no ties.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, kept, text_buffers

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# Bytes of one piece and of one call.
PIECE_BYTES = 128 << 10
BATCH_BYTES = 1 << 20

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

# Kinds of bytes: 0 beyond ASCII, 1 letter, 2 digit, 3 other ASCII, 4 the bar, which the
# special strings have after a letter.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[:128] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x7C] = 4


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places ``p`` of a text's bytes where a token ends at ``p`` whatever is around."""
    kind = _KIND[data]
    before, after = kind[:-1], kind[1:]
    plain = (before == 1) | (before == 2)
    return np.flatnonzero(plain & (after >= 1) & (after <= 3) & (before != after)) + 1


def pieces(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes that end at safe places, where there are any."""
    if len(data) <= limit:
        return [(0, len(data))]
    found, start, cuts = [], 0, safe_cuts(data)
    while len(data) - start > limit:
        after = int(np.searchsorted(cuts, start, side="right"))
        last = int(np.searchsorted(cuts, start + limit, side="right")) - 1
        place = max(last, after)
        if place >= len(cuts):
            break
        found.append((start, int(cuts[place])))
        start = int(cuts[place])
    return [*found, (start, len(data))]


class TokenCounter:
    """Lengths of texts as the tokenizers library encodes them."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = f"{folder}/{name}" if folder else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = _may_cut(json.loads(self.tokenizer.to_str()))

    def lengths(self, texts: list[str]) -> list[int]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [len(x) for x in found]

    def count(
        self, texts: pa.Array, piece: int = PIECE_BYTES, batch: int = BATCH_BYTES
    ) -> np.ndarray:
        """Tokens of each text."""
        offsets, raw = text_buffers(texts)
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        owners: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            np.add.at(counts, owners, self.lengths(held))
            owners.clear()
            held.clear()

        for row in range(len(counts)):
            data = raw[offsets[row] : offsets[row + 1]]
            for a, b in pieces(data, piece if self.cuts else len(data)):
                if b > a:
                    owners.append(row)
                    held.append(data[a:b].tobytes().decode("utf-8"))
                    size += b - a
                if size >= batch:
                    flush()
                    size = 0
        if held:
            flush()
        return counts


def _may_cut(spec: dict) -> bool:
    """Whether the rule of :func:`safe_cuts` holds for this tokenizer."""
    split = spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
    )
    # A special string must hold no safe place, and take no space around it along.
    for token in spec.get("added_tokens", []):
        text = np.frombuffer(token["content"].encode(), dtype=np.uint8)
        if len(safe_cuts(text)) or token["lstrip"] or token["rstrip"] or token["single_word"]:
            return False
    return plain


def count_tokens(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    tokenizer_dir: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(
            ("counter", tokenizer, tokenizer_dir),
            lambda: TokenCounter(tokenizer, tokenizer_dir),
        )
        for rows in batches:
            texts = rows.column("text")
            found = counter.count(texts)
            offsets, _ = text_buffers(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(found),
                    pa.array(found > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return texts.mapInArrow(frugal(count, keeps=True), SCHEMA)
