"""Text operators as Column expressions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.schema import EMBEDDED_BLOCKS, MIN_NOTE_CHARS

#: White space as the ECMAScript standard lists it; Java's \s is ASCII only.
WHITE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+\z", "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; astral characters count two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def tokens(c: Column) -> Column:
    """White-space tokens. The byte-pair encoding of the default model is optional, see bpe_tokens."""
    return F.filter(F.split(c, rf"{WHITE}+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def needs_chunking(c: Column, size: int) -> Column:
    return token_count(c) > size


@lru_cache(maxsize=4)
def _encoding(encoding_file: str):
    """A byte-pair encoding, read once for each worker process."""
    import base64

    import tiktoken

    with open(encoding_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    # A fixed value: the public split pattern of this encoding.
    pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(encoding_file: str):
    """A function text -> ids with a tiktoken rank file at a given path, which workers must be able to read."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        encode = _encoding(encoding_file).encode_ordinary
        return pa.array([encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return run


def chunk_texts(df: DataFrame, text: str = "text", size: int = 128, overlap: int = 16) -> DataFrame:
    """df with a row per chunk: chunk_index, chunk_text, start_index, end_index, token_count.

    A text of at most size tokens is one chunk, the text itself. Else chunks start every
    max(1, size - overlap) tokens until all have been starts, so a last chunk may lie inside the one
    before. Offsets are token places scaled to characters, halves rounded up. Chunks are cut within
    the row, so a text and its tokens are not copied to each of them.
    """
    step = max(1, size - overlap)
    whole = F.coalesce(F.col(text), F.lit(""))
    # Never empty, so inline_outer: for inline the optimizer would filter on a copy of the whole expression, tokens and all.
    base = df.withColumn("_tok", tokens(whole)).withColumn("_len", utf16_length(whole)).withColumn("_n", F.size("_tok"))

    def place(tok: Column) -> Column:
        return F.floor(tok * (F.col("_len").cast("double") / F.col("_n")) + F.lit(0.5)).cast("int")

    def chunk(at: Column, i: Column) -> Column:
        end = F.least(at + size, F.col("_n"))
        cut = F.array_join(F.slice("_tok", at + 1, F.greatest(end - at, F.lit(0))), " ")
        return F.struct(i.alias("chunk_index"), cut.alias("chunk_text"), place(at).alias("start_index"), place(end).alias("end_index"), (end - at).alias("token_count"))

    one = F.struct(F.lit(0).alias("chunk_index"), whole.alias("chunk_text"), F.lit(0).alias("start_index"), F.col("_len").alias("end_index"), F.col("_n").alias("token_count"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(step))
    base = base.withColumn("_chunks", F.when(F.col("_n") <= size, F.array(one)).otherwise(F.transform(starts, chunk)))
    return base.select(*[F.col(c) for c in df.columns], F.inline_outer("_chunks"))


def lines_of(text: str | Column) -> Column:
    """Lines of a text with the place after each: array of (content, end), in one pass over the text."""

    @F.arrow_udf("array<int>")
    def ends(lines: pa.Array) -> pa.Array:
        size = pc.utf8_length(lines.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        offsets = lines.offsets.to_numpy().astype(np.int64)
        upto = np.cumsum(size)
        before = np.r_[0, upto][offsets - offsets[0]]
        values = upto - np.repeat(before[:-1], np.diff(offsets)) - 1
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(values, pa.int32()))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.arrays_zip(lines.alias("content"), ends(lines).alias("end"))


def split_sections(df: DataFrame, content: str = "content", sections: str = "sections") -> DataFrame:
    """A row per section: ordinal, type, start_position, end_position, content cut at the offsets, anchor_id."""
    keep = [c for c in df.columns if c not in (content, sections)]
    out = df.select(*keep, F.col(content).alias("_text"), F.posexplode(sections).alias("ordinal", "_s"))
    cut = F.substring(F.col("_text"), F.col("_s.start.offset") + 1, F.col("_s.end.offset") - F.col("_s.start.offset"))
    return out.select(*keep, "ordinal", F.col("_s.type").alias("type"), F.col("_s.start").alias("start_position"), F.col("_s.end").alias("end_position"), cut.alias("content"), anchor_id(cut).alias("anchor_id"))


def anchor_id(content: Column) -> Column:
    """The name after ^ at the end of a block, else null."""
    return F.nullif(F.regexp_extract(content, rf"\^([a-zA-Z0-9-]+){WHITE}*\z", 1), F.lit(""))


def is_embedded_block(kind: Column) -> Column:
    return kind.isin(*EMBEDDED_BLOCKS)


def long_enough(text: Column) -> Column:
    return utf16_length(trim_white(text)) >= MIN_NOTE_CHARS


def cursor_context(text: Column, line: Column, col: Column, window: int = 64, around: int = 10) -> Column:
    """window words about the cursor, from the lines within around of it; '' where there are none."""
    lines = F.split(text, "\n")
    last = F.size(lines) - 1
    first = F.greatest(F.lit(0), line - around)
    upto = F.least(last, line + around)
    shown = F.slice(lines, first + 1, F.greatest(upto - first + 1, F.lit(0)))
    words = tokens(F.array_join(shown, "\n"))
    before = F.concat_ws("\n", F.slice(lines, first + 1, F.greatest(line - first, F.lit(0))), F.array(F.substring(F.element_at(lines, line + 1), F.lit(1), col)))
    index = F.size(tokens(before))
    half = window // 2
    lo = F.greatest(F.lit(0), index - half)
    hi = F.least(F.size(words), index + half)
    return F.when((line < 0) | (line > last), F.lit("")).otherwise(F.coalesce(F.array_join(F.slice(words, lo + 1, F.greatest(hi - lo, F.lit(0))), " "), F.lit("")))


def fts_sanitise(query: Column) -> Column:
    return trim_white(F.translate(query, "\"'", ""))


def snippet(text: Column, longest: int = 150) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def format_score(score: Column) -> Column:
    return F.format_string("%.3f", score)


def format_link(path: Column, name: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("|"), name, F.lit("]]"))


def copied(kind: Column, text: Column, path: Column, name: Column) -> Column:
    """What copying a result gives: a block's text, else a link."""
    return F.when(kind == "block", text).otherwise(format_link(path, name))


def note_title(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit(" - "), name)


def truncate_for_cloud(text: Column, most_tokens: int = 8000) -> Column:
    """Cut to 4 characters a token when the estimate is over most_tokens."""
    return F.when(F.ceil(F.length(text) / F.lit(4)) > most_tokens, F.substring(text, 1, 4 * most_tokens)).otherwise(text)


def is_markdown(path: Column) -> Column:
    return F.endswith(path, F.lit(".md"))


def stable_id(*parts: Column) -> Column:
    """A reproducible id from its parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 20)
