"""Column functions on text: tokens, n-grams, chunks, compression."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of at least ``least`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\w{{{least},}}"), F.lit(0))


def _grams(units: Column, n: int, between: str) -> Column:
    """Runs of ``n`` neighbouring units; shifted arrays are zipped, so each unit is read ``n`` times, not once per gram."""
    count = F.greatest(F.size(units) - n + 1, F.lit(0))
    grams = F.slice(units, F.lit(1), count)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(units, F.lit(k + 1), count), lambda g, u: F.concat(g, F.lit(between), u))
    return grams


def char_ngrams(text: Column, n: int) -> Column:
    return _grams(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), n, "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each beginning ``size - overlap`` after the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def lzw_codes(text: str) -> list[int]:
    """LZW over the text's UTF-8 bytes; codes from 256 on are for longer strings."""
    known = {bytes([k]): k for k in range(256)}
    out, held = [], b""
    for value in text.encode():
        longer = held + bytes([value])
        if longer in known:
            held = longer
        else:
            out.append(known[held])
            known[longer] = len(known)
            held = bytes([value])
    return [*out, known[held]] if held else out


def lzw_text(codes: list[int]) -> str:
    known = [bytes([k]) for k in range(256)]
    out: list[bytes] = []
    for code in codes:
        word = known[code] if code < len(known) else out[-1] + out[-1][:1]
        if out:
            known.append(out[-1] + word[:1])
        out.append(word)
    return b"".join(out).decode()


def lzw_compress(text: Column | str) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else lzw_codes(t))

    return F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)(text)


def lzw_decompress(codes: Column | str) -> Column:
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lists:
            yield s.map(lambda c: None if c is None else lzw_text([int(x) for x in c]))

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(codes)


def sha3_256(text: Column | str) -> Column:
    """The SHA3-256 digest in hexadecimal, which no built-in function gives; null stays null."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: None if x is None else hashlib.sha3_256(x.encode()).hexdigest())

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(text)


def huffman_codes(counts: dict[str, int]) -> dict[str, str]:
    """A prefix code of least total length; ties by the smallest symbol below a node. One symbol gets "0"."""
    heap = [(n, c, c) for c, n in sorted(counts.items())]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {heap[0][1]: "0"}
    while len(heap) > 1:
        (n, a, left), (m, b, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, min(a, b), (left, right)))
    codes: dict[str, str] = {}
    stack = [(heap[0][2], "")] if heap else []
    while stack:
        node, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes


def tokens_without(stop_words: list[str], least: int = 2, stem: bool = False):
    """A tokenizer: word tokens apart from ``stop_words``; with ``stem``, common English endings are cut off."""

    def tokenize(text: Column) -> Column:
        kept = F.filter(word_tokens(text, least), lambda w: ~w.isin(*stop_words))
        return F.transform(kept, stemmed) if stem else kept

    return tokenize


#: Endings that ``stemmed`` cuts off where three letters at least stay; the longest that fits goes.
ENDINGS = "ations|ation|ingly|edly|ings|ing|ness|ment|ies|ed|es|ly|s"


def stemmed(word: Column) -> Column:
    """A word without one common English ending: a crude stem, the same for the forms of a regular word."""
    return F.regexp_replace(word, rf"^(\w{{3,}}?)(?:{ENDINGS})$", "$1")
