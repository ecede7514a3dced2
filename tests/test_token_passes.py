"""The passes of the Treebank-like tokens give what the rules give one after the other."""

import random

from pyspark.sql import functions as F

from roomrate import constants as K
from roomrate.functions.text import treebank_tokens

PIECES = ["mr", "st", "a", "b", "u.s", "can", "not", "cannot", "gonna", "wanna", "gotta", "gimme", "lemme", "tis", "twas", "n't", "'s", "'ll", "'",
          "’", ".", "..", "-", "--", "—", ",", "(", ")", "[", "]", "\"", "`", "``", "''", "$", "%", "?", "!", "«", "é", "😀", "\ue000", "\u2028",
          "\u0085", "\xa0", "1", "23", "x", "word", "don't", "it's", "_", "=", "\\", " ", " ", " ", "\n", "\t"]


def _by_rules(x):
    out = F.regexp_replace(F.lower(F.col(x)), r"\d+", "")
    for pattern, into in K.TOKEN_RULES:
        out = F.regexp_replace(out, pattern, into.replace("\\", "$"))
    return F.filter(F.split(out, " +"), lambda w: F.regexp_like(w, F.lit(K.TOKEN_KEPT)))


def test_passes_are_the_rules(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(30000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", treebank_tokens("s").alias("got"), _by_rules("s").alias("want"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).limit(5).collect() == []
    assert df.where(F.size("got") > 2).count() > 3000


def test_a_text_is_read_in_few_passes():
    assert 2 * sum(pattern is not None for pattern, _ in K.TOKEN_PASSES) < len(K.TOKEN_RULES)
