"""Text expressions: tokens, chunkers and markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranksmith.functions.binding import let

WORD = r"[a-z0-9]+"
DEFAULT_DELIMITER, DEFAULT_CHAR_LIMIT, DEFAULT_TOKEN_LIMIT, DEFAULT_CHUNK_LIMIT = "\n\n", 2048, 384, 100
#: Tokenizers of the fixed-length chunker, as patterns of one token.
TOKENIZERS = {
    "standard": r"[\p{L}\p{N}\p{M}_]+(?:['’.][\p{L}\p{N}\p{M}_]+)*",
    "letter": r"\p{L}+",
    "lowercase": r"\p{L}+",
    "whitespace": r"\S+",
    "uax_url_email": r"[a-zA-Z][a-zA-Z0-9+.-]*://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\p{L}\p{N}\p{M}_]+(?:['’.][\p{L}\p{N}\p{M}_]+)*",
    "classic": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\p{L}\p{N}_]+(?:['.&-][\p{L}\p{N}_]+)*",
    "thai": r"[\p{L}\p{N}\p{M}_]+",
}


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased tokens in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))


def tokens_among(text: Column, terms) -> Column:
    """Those of ``tokens`` that are among ``terms``, in order: one search for all terms, so other tokens are never made."""
    if not terms:
        return F.array().cast("array<string>")
    pattern = r"(?<![a-z0-9])(" + "|".join(re.escape(t) for t in sorted(terms)) + r")(?![a-z0-9])"
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), 1), F.array().cast("array<string>"))


def _check_overlap(rate: float) -> None:
    if not 0 <= rate <= 0.5:
        raise ValueError("overlap_rate must be between 0 and 0.5")


def _no_limit(limit: int | Column) -> bool:
    return not isinstance(limit, Column) and limit == -1


def _check_limit(limit: int | Column) -> None:
    if not isinstance(limit, Column) and limit != -1 and limit <= 0:
        raise ValueError("max_chunk_limit must be positive, or -1 for none")


def limited(chunks: Column, limit: int | Column = -1, others: int = 0) -> Column:
    """At most ``limit`` chunks less ``others`` strings still to come: the rest is joined into the last one."""
    _check_limit(limit)
    if _no_limit(limit):
        return chunks
    most = F.greatest((limit if isinstance(limit, Column) else F.lit(limit)) - others, F.lit(1))

    def cut(c: Column) -> Column:
        rest = F.concat_ws("", F.slice(c, most, F.greatest(F.size(c) - most + 1, F.lit(0))))
        head = F.slice(c, F.lit(1), most - 1)
        return F.when(F.size(c) <= most, c).otherwise(F.concat(head, F.array(rest)))

    return let(chunks, cut)


def chunk_delimiter(text: Column, delimiter: str = DEFAULT_DELIMITER, limit: int | Column = -1) -> Column:
    """Pieces that end with the delimiter; what follows the last one is a piece of its own."""
    if not delimiter:
        raise ValueError("delimiter must not be empty")
    pieces = F.regexp_extract_all(text, F.lit(rf"((?s).*?{re.escape(delimiter)}|.+\z)".replace("((?s)", "(?s)(")), 1)
    return limited(F.coalesce(pieces, F.array().cast("array<string>")), limit)


def _starts(length: Column, size: int, rate: float) -> Column:
    """First positions of pieces of ``size`` that overlap; the last piece reaches the end."""
    step = size - int(size * rate)
    more = F.greatest(F.lit(0), F.ceil((length - F.lit(size)) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), more), lambda i: i * step)


def chunk_fixed_char(text: Column, char_limit: int = DEFAULT_CHAR_LIMIT, overlap_rate: float = 0.0, limit: int | Column = -1) -> Column:
    """Pieces of ``char_limit`` characters. With a chunk limit the last allowed piece runs to the end of the text."""
    _check_overlap(overlap_rate)
    _check_limit(limit)
    if char_limit <= 0:
        raise ValueError("char_limit must be positive")

    def cut(starts: Column) -> Column:
        if _no_limit(limit):
            return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(char_limit)))
        return F.transform(F.slice(starts, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit)), lambda s, i: F.substring(text, s + 1, F.when((i == limit - 1) & (F.size(starts) > limit), F.length(text)).otherwise(F.lit(char_limit))))

    pieces = let(_starts(F.length(text), char_limit, overlap_rate), cut)
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def chunk_fixed_token(text: Column, token_limit: int = DEFAULT_TOKEN_LIMIT, overlap_rate: float = 0.0, tokenizer: str = "standard", limit: int | Column = -1) -> Column:
    """Pieces of ``token_limit`` tokens cut out of the text with whatever stands between; the first starts at its start.

    A piece runs from its first token to the first token of the piece's successor. Token offsets come from the pieces that
    a split at token starts gives, so every expression stays in the JVM."""
    _check_overlap(overlap_rate)
    _check_limit(limit)
    if token_limit <= 0:
        raise ValueError("token_limit must be positive")
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; known: {', '.join(TOKENIZERS)}")
    # Each match is one token with the separators after it; separators before the first token join the first piece.
    token = TOKENIZERS[tokenizer]
    tail = r"\s*" if tokenizer == "whitespace" else rf"(?:(?!{token})[\s\S])*"
    head = F.regexp_extract(text, rf"^(?:(?!{token})[\s\S])*", 0)
    parts = F.regexp_extract_all(text, F.lit(rf"((?:{token}){tail})"), 1)
    parts = F.when(F.size(parts) > 0, F.transform(parts, lambda p, i: F.when(i == 0, F.concat(head, p)).otherwise(p))).otherwise(F.array(text))

    def cut(p: Column, starts: Column) -> Column:
        def join(start: Column, last: Column) -> Column:
            return F.concat_ws("", F.slice(p, start + 1, F.when(last, F.size(p)).otherwise(F.lit(token_limit))))

        allowed = starts if _no_limit(limit) else F.slice(starts, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))
        return F.transform(allowed, lambda s, i: join(s, (i == limit - 1) & (F.size(starts) > limit)))

    pieces = let(parts, lambda p: let(_starts(F.size(p), token_limit, overlap_rate), lambda starts: cut(p, starts)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


ALGORITHMS = {"delimiter": chunk_delimiter, "fixed_char_length": chunk_fixed_char, "fixed_token_length": chunk_fixed_token}


def chunker(algorithm: str, **parameters):
    """A function of a text column for one algorithm by name; unknown names and parameters are errors."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown chunking algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    names = {"max_chunk_limit": "limit"}
    own = {names.get(k, k): v for k, v in parameters.items()}
    ALGORITHMS[algorithm](F.lit("x"), **own)  # checks the parameters now
    return lambda text: ALGORITHMS[algorithm](text, **own)


def chunk_list(texts: Column, chunk) -> Column:
    """A list of strings to the chunks of all of them, in order."""
    return F.flatten(F.transform(texts, chunk))


def chunk_texts(texts: Column, algorithm: str, **parameters) -> Column:
    """The chunks of a list of strings under one limit: each string may use what the ones before have left, less one chunk for
    each string to come."""
    own = dict(parameters)
    limit = own.pop("max_chunk_limit", own.pop("limit", -1))
    if limit == -1:
        return chunk_list(texts, chunker(algorithm, **own))
    chunker(algorithm, **own, max_chunk_limit=limit)  # checks the parameters
    start = F.struct(F.array().cast("array<string>").alias("out"), F.size(texts).alias("left"))

    def add(s: Column, t: Column) -> Column:
        most = F.greatest(F.lit(limit) - F.size(s["out"]) - (s["left"] - 1), F.lit(1))
        chunks = F.coalesce(ALGORITHMS[algorithm](t, **own, limit=most), F.array().cast("array<string>"))
        return F.struct(F.concat(s["out"], chunks).alias("out"), (s["left"] - 1).alias("left"))

    return F.aggregate(texts, start, add, lambda s: s["out"])


def cascade(text: Column, *chunkers) -> Column:
    """Chunkers one after another, each over the pieces of the one before."""
    pieces = F.array(text)
    for chunk in chunkers:
        pieces = chunk_list(pieces, chunk)
    return pieces


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def apply_tags(text: Column, spans: Column, pre: str = "<em>", post: str = "</em>", escape: bool = False) -> Column:
    """``text`` with tags around spans (``start`` from 0, ``end`` beyond the last character), which are sorted here.

    Spans must lie within the text, hold at least a character and not overlap; else the query fails."""
    clean = escape_html if escape else (lambda x: x)

    def pieces(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.element_at(s, F.greatest(i, F.lit(1)))["end"])
            fine = (x["start"] >= at) & (x["start"] < x["end"]) & (x["end"] <= F.length(text))
            begin = F.when(fine, x["start"]).otherwise(F.raise_error(F.lit("highlight spans must not overlap and must lie within the text")).cast("int"))
            return F.concat(clean(F.substring(text, at + 1, begin - at)), F.lit(pre), clean(F.substring(text, begin + 1, x["end"] - begin)), F.lit(post))

        rest = F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1))["end"]).otherwise(0)
        return F.concat(F.array_join(F.transform(s, piece), ""), clean(F.substring(text, rest + 1, F.length(text))))

    return let(F.array_sort(spans), pieces)
