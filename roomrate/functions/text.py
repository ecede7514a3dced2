"""Text column expressions: amenity normalisation, splitting, n-grams, token cleaning.

All built from Spark SQL built-ins (translate/replace/split/regexp_extract_all and
higher-order array functions), so whole texts are processed JVM-side.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomrate import constants as K

# Characters deleted from amenity text: ASCII punctuation except "-", "," and "/".
AMENITY_DELETE_CHARS = "".join(ch for ch in string.punctuation if ch not in K.AMENITY_KEEP_PUNCT)

# Word token: a maximal run of letters (digits are removed before tokenising).
WORD_TOKEN_REGEX = r"\p{L}+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_amenity_text(x) -> Column:
    """Raw amenity text -> normalised text (before splitting). (F8)

    lower -> delete punctuation (underscore included) -> fixed replacements in order.
    `replace(',,', ',')` is a single non-overlapping pass, as in the source."""
    out = F.translate(F.lower(_c(x)), AMENITY_DELETE_CHARS, "")
    for old, new in K.AMENITY_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def amenity_tokens(x) -> Column:
    """Raw amenity text -> array of tokens (may contain ''); NULL text -> empty array."""
    return F.coalesce(F.split(normalise_amenity_text(x), ",", -1), F.array().cast("array<string>"))


def amenity_token_set(x, renames: dict | None = K.AMENITY_RENAMES) -> Column:
    """Distinct non-empty tokens with the post-encoding renames applied."""
    toks = F.array_distinct(F.filter(amenity_tokens(x), lambda t: t != F.lit("")))
    if renames:
        mapping = F.create_map(*[F.lit(v) for kv in renames.items() for v in kv])
        toks = F.array_distinct(F.transform(toks, lambda t: F.coalesce(F.element_at(mapping, t), t)))
    return toks


def join_tokens(x, delimiter: str = "|") -> Column:
    """array -> 'a|b|c'."""
    return F.array_join(_c(x), delimiter)


def word_tokens(x) -> Column:
    """lower -> strip digit runs -> letter-run tokens. NULL text -> empty array.

    Approximates a treebank word tokenizer followed by 'keep tokens holding a word
    character': after digits are removed the kept tokens are letter runs."""
    cleaned = F.regexp_replace(F.lower(_c(x)), r"\d+", "")
    return F.coalesce(F.regexp_extract_all(cleaned, F.lit(WORD_TOKEN_REGEX), 0),
                      F.array().cast("array<string>"))


def treebank_tokens(x) -> Column:
    """lower -> strip digit runs -> Treebank-like words that hold a letter: contractions are split (do n't, host 's), hyphenated
    words, abbreviations and initials are kept whole. NULL text -> empty array. (X1)"""
    out = F.regexp_replace(F.lower(_c(x)), r"\d+", "")
    out = F.concat(F.lit("  "), F.regexp_replace(out, K.TOKEN_LAST_LINE_END, "  $1"), F.lit("  "))
    for pattern, into in K.TOKEN_PASSES:
        out = F.regexp_replace(out, pattern, into) if pattern else F.replace(out, *map(F.lit, into))
    words = F.array_remove(F.split(F.regexp_replace(out, K.TOKEN_DROPPED, ""), " +"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def gram_arrays(tokens, n: int) -> Column:
    """array of tokens -> array of n-token arrays, built from n shifted slices zipped together.

    No lambda refers back to `tokens`, so even if the optimizer inlines the token
    expression (e.g. into the filter it infers for explode) it is evaluated a fixed
    number of times per row, never once per gram."""
    t = _c(tokens)
    m = F.size(t) - F.lit(n - 1)
    zipped = F.arrays_zip(*[F.slice(t, k + 1, m).alias(f"w{k}") for k in range(n)])
    grams = F.transform(zipped, lambda z: F.array(*[z[f"w{k}"] for k in range(n)]))
    return F.when(F.size(t) >= F.lit(n), grams).otherwise(F.array().cast("array<array<string>>"))


def ngrams(tokens, n: int) -> Column:
    """array of tokens -> array of space-joined n-grams (empty when fewer than n tokens)."""
    return F.transform(gram_arrays(tokens, n), lambda g: F.array_join(g, " "))


def default_stop_words() -> tuple[str, ...]:
    """English stop words (the list shipped with Spark ML, kept as a fixed value)."""
    return tuple(K.ENGLISH_STOP_WORDS)


def drop_stop_grams(grams, stop_words=None) -> Column:
    """Keep n-token arrays holding no stop word, joined with spaces."""
    stop = F.array(*[F.lit(w) for w in (stop_words or default_stop_words())])
    kept = F.filter(_c(grams), lambda g: ~F.exists(g, lambda w: F.array_contains(stop, w)))
    return F.transform(kept, lambda g: F.array_join(g, " "))


def filtered_ngrams(x, n: int, stop_words=None) -> Column:
    """Text -> n-grams, then drop every gram holding a stop word.

    Grams are formed first and filtered after, so no gram bridges a removed word."""
    return drop_stop_grams(gram_arrays(word_tokens(x), n), stop_words)


def clean_tokens(x, stop_words=None, extra=K.EXTRA_STOP_WORDS) -> Column:
    """Digit-free, lower-case letter tokens minus stop words and an extra list."""
    words = list(stop_words or default_stop_words()) + list(extra or ())
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(word_tokens(x), lambda w: ~F.array_contains(stop, w))


def gram_vocabulary_hits(grams, vocabulary, match_subgram: bool = False) -> Column:
    """Grams ('a b') joined with '_' that are vocabulary tokens; optionally single words too."""
    vocab = F.array(*[F.lit(v) for v in vocabulary]) if not isinstance(vocabulary, Column) else vocabulary
    joined = F.transform(_c(grams), lambda g: F.replace(g, F.lit(" "), F.lit("_")))
    hits = F.array_intersect(joined, vocab)
    if match_subgram:
        words = F.flatten(F.transform(_c(grams), lambda g: F.split(g, " ")))
        hits = F.array_union(hits, F.array_intersect(words, vocab))
    return hits


def exploded_ngrams(df, tokens: str, n: int, keep=(), stop_words=None, out: str = "gram"):
    """One row per n-gram that holds no stop word: (keep..., gram).

    Lambda-free on purpose: shifted slices are zipped and exploded, the stop-word test is a
    column `isin` (planned as a hashed InSet inside whole-stage codegen) and the words are
    joined with concat_ws. Higher-order functions are interpreted per element; this form is
    several times faster on long documents. Short token lists give no rows (slice length is
    clamped at 0)."""
    t = F.col(tokens)
    m = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(t, k + 1, m).alias(f"w{k}") for k in range(n)])
    rows = df.select(*keep, F.explode(zipped).alias("_g"))
    words = [F.col(f"_g.w{k}") for k in range(n)]
    stop = list(stop_words or default_stop_words())
    cond = None
    for w in words:
        c = ~w.isin(stop)
        cond = c if cond is None else cond & c
    return rows.where(cond).select(*keep, F.concat_ws(" ", *words).alias(out))
