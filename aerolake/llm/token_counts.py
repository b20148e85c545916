"""Operator 6: token counts of whole texts, with overlap resynchronisation for huge documents.

A text of more than ``huge_chars`` code points is encoded in chunks that overlap by twice ``overlap_chars``. Two neighbours are
spliced at a stable boundary in the middle of their overlap, at which both encodings must start a token. Stable are the
positions of ``BOUNDARY``: before a letter, digit or mark that follows white space, between a letter and a mark, and on either side
of a digit. There the tokenizer's word pattern, which only looks forward, ends one word and starts the next whatever stands
before or after; the characters named never compose with what precedes them; and special strings and elisions, which could span the
place, are kept out by their first signs. So from there on the right chunk yields what the whole text yields, and up to it the
left chunk does. If a chunk's end holds no such place, the overlap is widened backwards, at last to the chunk's start; then the
chunk grows forward to the next place. Only text without any, one single word, is encoded at once. Where two encodings do not
start a token at the same place, the next place before it is tried.

Shorter texts are cut at single ASCII spaces and line feeds, where the same argument holds, and every distinct
piece is encoded once per worker (a bounded cache keeps the counts of frequent pieces).

Null and empty texts have no tokens. Extra columns are dropped; repeated rows are returned as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

HUGE_CHARS = 50_000
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
CACHE_WORDS = 300_000
#: Letters and marks whose kind no Unicode version disputes and that compose with nothing before them.
LETTER = "a-zA-ZÀ-ÖØ-öø-ÿА-яァ-ヺぁ-ゖ一-龥가-힣"
MARK = "!\"#$%&()*+,\\-./:;=?@\\[\\]^_{}~、。〈-】！（），：；？"
#: A character after which a boundary lies, looking at the next one; '<', '|' and apostrophes end or start none.
BOUNDARY = re.compile(f"[ \n](?=[{LETTER}0-9{MARK}])|[{LETTER}](?=[{MARK}0-9])|[{MARK}](?=[{LETTER}0-9])|[0-9](?=[{LETTER}0-9{MARK}])")


def load_tokenizer(path: str):
    """A tokenizer that runs in one thread, neither truncates nor pads."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def token_starts(tokenizer, text: str) -> np.ndarray:
    return np.fromiter((a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets), np.int64)


def boundary_after(text: str, low: int, high: int) -> int | None:
    """The first stable boundary in (low, high]."""
    found = BOUNDARY.search(text, max(low, 0), min(len(text), high + 1))
    return found.start() + 1 if found else None


def boundaries_before(text: str, low: int, high: int, overlap: int) -> Iterator[int]:
    """Stable boundaries in (low, high), from the last on, looked for in ever longer stretches."""
    past = high
    while past > low:
        at = max(low, past - overlap)
        places = [m.start() + 1 for m in BOUNDARY.finditer(text, max(at - 1, 0), min(len(text), past + 1))]
        yield from (p for p in reversed(places) if at < p <= past and low < p < high)
        past, overlap = at, 2 * overlap


def count_huge(tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, of which at most a chunk and its overlaps are encoded at a time."""
    if chunk_chars <= overlap_chars:
        raise ValueError("a chunk must be longer than the overlap")
    total, begin = 0, 0
    while len(text) - begin > chunk_chars + overlap_chars:
        cut, wanted = None, begin + chunk_chars
        for place in boundaries_before(text, begin, wanted, overlap_chars):
            if (tokens := agreed(tokenizer, text, begin, place, overlap_chars)) is not None:
                cut = place
                break
        while cut is None:
            if (place := boundary_after(text, wanted - 1, len(text))) is None or place >= len(text):
                break
            if (tokens := agreed(tokenizer, text, begin, place, overlap_chars)) is not None:
                cut = place
            wanted = place + 1
        if cut is None:
            break
        total, begin = total + tokens, cut
    return total + len(token_starts(tokenizer, text[begin:]))


def agreed(tokenizer, text: str, begin: int, cut: int, overlap: int) -> int | None:
    """Tokens from one boundary to the next, if the chunk around them and a chunk around the cut both start a token at the cut."""
    left = token_starts(tokenizer, text[begin : cut + overlap]) + begin
    at = max(begin, cut - overlap)
    right = token_starts(tokenizer, text[at : cut + overlap]) + at
    return int((left < cut).sum()) if cut in left and cut in right else None


class WordCounter:
    """Token counts of pieces without ASCII space or line feed, distinct pieces of a batch at a time."""

    def __init__(self, tokenizer, most: int = CACHE_WORDS):
        self.tokenizer, self.most, self.known = tokenizer, most, {"": 0}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        counts = list(map(known.get, words))
        if missing := [i for i, n in enumerate(counts) if n is None]:
            for lot in range(0, len(missing), 2000):
                at = missing[lot : lot + 2000]
                for i, found in zip(at, self.tokenizer.encode_batch_fast([words[i] for i in at], add_special_tokens=False), strict=True):
                    counts[i] = len(found.ids)
                    if len(known) < self.most and len(words[i]) < 64:
                        known[words[i]] = counts[i]
        return np.array(counts, np.int64)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of each text, the offset of its first piece among the pieces of all (one more at the end); the pieces."""
    pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    return pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 2048, huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        counter = WordCounter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = pc.fill_null(part["text"], "")
                counts = np.zeros(len(texts), np.int64)
                huge = pc.greater(pc.utf8_length(texts), huge_chars)
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                    counts[i] = count_huge(tokenizer, texts[i].as_py(), chunk_chars, overlap_chars)
                offsets, words = split_words(pc.if_else(huge, "", texts))
                per_word = counter(words.dictionary.to_pylist())[words.indices.to_numpy()]
                counts += np.add.reduceat(per_word, offsets[:-1]) if len(texts) else 0
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
