"""Splitting oversized texts at natural boundaries, with overlap, in tokens of a public tokenizer.

A text becomes a string with one letter a token that tells what ends behind the token: P a paragraph, L a line,
S a sentence, W a word, c a character, x nothing (inside a character). A regular expression with bounded quantifiers
and alternatives in order of boundary strength cuts that string; lookback from each cut finds where the overlap starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm import tokens

#: What a code point is, up to the last one that matters: bit 0 white space, bit 1 ends a sentence, bit 2 may follow that.
_KINDS = np.array([chr(c).isspace() | (chr(c) in ".!?…。") << 1 | (chr(c) in "\"')]}»”’`*") << 2 for c in range(0x3003)] + [0], np.uint8)


def boundaries(text: str, path: str, above: int = 0) -> tuple[str, np.ndarray, np.ndarray]:
    """One letter a token, and the offsets in characters and in bytes behind each token; nothing for a text of at most
    ``above`` tokens.

    A cut before white space, behind something else, leaves the tokens of both sides as they were, because the
    tokenizer's pattern looks ahead only from inside white space and never back."""
    _, lengths = tokens.encoding(path)
    ids = np.asarray(tokens.encode(text, path), np.int64)
    if len(ids) <= above:
        return "", np.empty(0, np.int32), np.empty(0, np.int32)
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    char_ends = np.cumsum(width)
    token_ends = np.cumsum(lengths[ids])
    ends = np.searchsorted(char_ends, token_ends, "left") + 1
    ends = np.minimum(ends, len(chars))
    whole = char_ends[ends - 1] == token_ends
    kinds = _KINDS[np.minimum(chars, len(_KINDS) - 1)]
    space = (kinds & 1).astype(bool)
    newline = (chars == 10) | ((chars == 13) & (np.append(chars[1:], 0) != 10))
    lines = np.concatenate([[0], np.cumsum(newline)])
    solid = np.where(space, len(chars), np.arange(len(chars)))
    next_solid = np.append(np.minimum.accumulate(solid[::-1])[::-1], len(chars))
    inside = np.minimum(ends, len(chars) - 1)
    natural = whole & (ends < len(chars)) & space[inside] & ~space[ends - 1]
    breaks = lines[next_solid[ends]] - lines[ends]
    last, before = kinds[ends - 1], kinds[np.maximum(ends - 2, 0)]
    stop = ((last & 2) > 0) | (((last & 4) > 0) & ((before & 2) > 0))
    letter = np.where(whole, ord("c"), ord("x")).astype(np.uint8)
    letter[natural] = np.where(breaks >= 2, ord("P"), np.where(breaks == 1, ord("L"), np.where(stop, ord("S"), ord("W"))))[natural]
    letter[-1] = ord("P")
    ends[-1] = len(chars)
    return letter.tobytes().decode("ascii"), ends.astype(np.int32), char_ends[ends - 1].astype(np.int32)


def pattern(limit: int, overlap: int) -> str:
    """Pieces of at most ``limit`` - ``overlap`` tokens: the rest whole, else the strongest boundary that fills at
    least half, else any word, else any character with room left for tokens that change at such a cut."""
    most = limit - overlap
    half, quarter, safe = most // 2, most // 4, most - most // 8
    strong = "|".join(f".{{{half},{most - 1}}}{b}" for b in "PLS")
    return rf".{{1,{most}}}\z|{strong}|.{{{quarter},{most - 1}}}[PLSW]|.{{0,{safe - 1}}}[PLSWc]"


def split_texts(docs: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, path: str | None = None) -> DataFrame:
    """(key, piece, start_char, end_char, n_tokens, overlap_tokens, text) for each text above ``limit`` tokens.

    A piece is text[start_char:end_char]; it has at most ``limit`` tokens, and shares up to ``overlap`` tokens with
    the piece before, from the first word boundary in that stretch (a character where there is none). Without their
    overlaps the pieces give the text back exactly. Tokens are counted in the whole text; at cuts inside a word the
    count of the piece alone may differ by a few, for which the pattern leaves room.

    Null and empty texts and texts of at most ``limit`` tokens have no pieces. Repeated rows come out as often as
    they occur. Very long texts are cut by the same rule, in time that grows with their length. Extra columns are ignored."""
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must be between 0 and half the limit")
    path = path or tokens.default_path()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 64):
                rows, found = [], []
                for i in range(lo, min(lo + 64, len(texts))):
                    one = boundaries(texts[i], path, limit)
                    if one[0]:
                        rows.append(i), found.append(one)
                if rows:
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in found])]), pa.int32())
                    ends, byte_ends = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found]), pa.int32())) for k in (1, 2))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([texts[i].encode("utf-8", "replace") for i in rows], pa.binary()), pa.array([x[0] for x in found], pa.string()), ends, byte_ends], ["key", "body", "letters", "ends", "byte_ends"])

    kind = docs.schema[key].dataType.simpleString()
    long = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    marked = long.mapInArrow(classify, f"key {kind}, body binary, letters string, ends array<int>, byte_ends array<int>")

    def piece(cuts, body, letters, i):
        frm, to = F.get(cuts, i), F.get(cuts, i + 1)
        first = F.greatest(frm - overlap, F.lit(1))
        # Bytes are cut out in one go, where characters would be counted from the start of the text.
        tail = F.substring(letters, first, F.lit(overlap)).cast("string")
        word, char = F.length(F.regexp_extract(tail, "^[^PLSW]*[PLSW]", 0)), F.length(F.regexp_extract(tail, "^x*[PLSWc]", 0))
        back = F.when(word > 0, word).otherwise(char)
        begin = F.when((i == 0) | F.lit(overlap == 0) | (back == 0), frm).otherwise(F.least(first - 1 + back, frm))

        def cut(begin):
            start, at = (F.when(begin == 0, F.lit(0)).otherwise(F.get(c, begin - 1)) for c in ("ends", "byte_ends"))
            return F.struct(i.alias("piece"), start.alias("start_char"), F.get("ends", to - 1).alias("end_char"), (to - begin).alias("n_tokens"), (frm - begin).alias("overlap_tokens"),
                            F.substring(body, at + 1, F.get("byte_ends", to - 1) - at).cast("string").alias("text"))

        return _let(begin, cut)

    sizes = F.transform(F.regexp_extract_all("letters", F.lit(pattern(limit, overlap)), F.lit(0)), F.length)
    each = lambda cuts, body, letters: F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda i: piece(cuts, body, letters, i))
    pieces = _let(sizes, lambda n: _let(_running(n), lambda cuts: _let(F.col("body"), lambda body: _let(F.col("letters").cast("binary"), lambda letters: each(cuts, body, letters)))))
    return marked.select(F.col("key").alias(key), F.inline(pieces))


def _let(value, body):
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes):
    """0 and the running sums of an array. The sums are made in blocks of the square root of its length, since an array
    that grows by one copies itself each time."""
    width = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int"))
    block = lambda b, w: F.slice(sizes, b * w + 1, w)
    grow = lambda a, start: F.aggregate(a, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def sums(w):
        totals = F.transform(blocks, lambda b: F.aggregate(block(b, w), F.lit(0), lambda a, n: a + n))
        return _let(grow(totals, F.lit(0)), lambda starts: F.concat(F.array(F.lit(0)), F.flatten(F.transform(blocks, lambda b: F.slice(grow(block(b, w), F.get(starts, b)), F.lit(2), w)))))

    return _let(width, sums)
