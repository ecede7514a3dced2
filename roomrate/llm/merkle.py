"""Merkle dataset manifest (13): a content-addressed DAG, descended for the proofs of all leaves.

Every row is a leaf, the digest of its fields; the rows of a language, by doc_id, are the leaves of a tree in which ARITY
consecutive nodes become the digest of their concatenated digests (hex), level by level; the trees' tops (subroots),
by language, are the leaves of a last tree, whose top is the root.

* Ranks: rows are range-sorted by (language, doc_id) and written; a row's rank is its place in its partition plus the
  rows of its language in the partitions before, so a language that holds most rows is dealt out like any other.
* Store: digest -> children. A record spans LIFT levels (a segment): ARITY^LIFT consecutive nodes of one level, the
  levels between them and the digest that they become. One grouped aggregate builds a segment level of all languages; a
  group has ARITY^LIFT rows at most. Equal subtrees are one record.
* Proofs: requests begin at the root and descend by the digits of their rank: the record of a digest is looked up, the
  digit's child is followed, and the children that it does not select are collected. Leaves that share a segment share
  the descent to it (a row per segment, not per leaf); only the last step is one of each leaf. The segments of the path,
  root first, are reversed at the end, so that siblings stand level by level from the leaf up.
* A proof folds a leaf with its siblings back to a root; verified tells whether it is the manifest's.

Defined results: a null field has an encoding of its own; null doc_ids come first, rows of one doc_id are ordered by leaf;
repeated rows are leaves of their own; a null language is a language, the first; a single leaf or language is its own top;
an empty table gives an empty table; very long texts only pass through the digest of their row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomrate.llm.storage import KEY, keyed, written

ARITY = 2
#: levels of a segment
LIFT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of an array of strings, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else number of UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.array(*[encoded(f) for f in fields]))


def height(n: Column) -> Column:
    """Levels above n nodes: digits of n - 1 to the base ARITY, none for a single node."""
    return F.when(n > 1, F.length(F.conv(n - 1, 10, ARITY))).otherwise(0)


def levels(nodes: Column, lift: Column) -> Column:
    """The nodes and the `lift` (1 at least) levels above them, the last of one digest."""
    def above(low):
        last = F.ceil(F.size(low) / ARITY).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.slice(low, i * ARITY + 1, ARITY)))

    return F.aggregate(F.sequence(F.lit(1), lift), F.array(nodes).cast("array<array<string>>"),
                       lambda found, _: F.concat(found, F.array(above(F.element_at(found, -1)))).cast("array<array<string>>"))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `rank` (0, 1, ... in each group by `order`) and `n`, the group's rows."""
    rows = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("__place", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__place", 33))
    runs = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    own = Window.partitionBy("__g")  # a row for each partition that holds rows of the group
    before = own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"n": F.sum("__n").over(own), "__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    return (rows.join(runs, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
            .withColumn("rank", F.col("__before") + F.col("__place") - F.col("__first"))
            .drop("__place", "__part", "__g", "__p", "__n", "__first", "__before"))


def stored(nodes: DataFrame, lift: int) -> tuple[DataFrame, list[DataFrame]]:
    """((group, n, digest) of every tree's top, records (digest, levels) of the store by segment level, lowest first) of
    nodes (group, rank, n, digest). The driver goes through the segment levels: five at 10^12 leaves."""
    most = nodes.agg(F.max(height(F.col("n")))).first()[0] or 0
    tops, store = nodes.where("n = 1").select("group", "n", "digest"), []
    for done in range(0, most, lift):
        up = F.least(height(F.col("n")) - done, F.lit(lift))
        made = (nodes.where(up > 0).groupBy("group", "n", F.floor(F.col("rank") / ARITY ** lift).alias("rank"))
                .agg(F.array_sort(F.collect_list(F.struct("rank", "digest")))["digest"].alias("nodes"))
                .select("group", "n", "rank", levels(F.col("nodes"), up).alias("levels")))
        made = written(made.withColumn("digest", F.element_at("levels", -1)[0]), "merkle-segments")
        store.append(made.select("digest", "levels").dropDuplicates(["digest"]))
        tops = tops.union(made.where((height(F.col("n")) > done) & (height(F.col("n")) <= done + lift)).select("group", "n", "digest"))
        nodes = made.select("group", "n", "rank", "digest")
    return tops, store


PATH = "array<struct<digit:int,others:array<string>>>"


def way(found: Column, child: Column) -> Column:
    """The way from a record's digest down to its child number `child`: for each level, the selected place in its run
    and the other digests of the run, in order; empty without a record."""
    def step(i):
        place = F.floor(child / F.pow(F.lit(ARITY), i)).cast("int")
        digit = place % ARITY
        run = F.slice(found[i], place - digit + 1, ARITY)
        return F.struct(digit.alias("digit"), F.concat(F.slice(run, F.lit(1), digit), F.slice(run, digit + 2, F.lit(ARITY))).alias("others"))

    return F.coalesce(F.transform(F.reverse(F.sequence(F.lit(0), F.size(found) - 2)), step), F.array()).cast(PATH)


def descended(tops: DataFrame, store: list[DataFrame], lift: int) -> DataFrame:
    """(the columns of tops, segment, levels) of every lowest segment, from tops (digest, n, path, ...): `digest` becomes
    the segment's and `path` gains the way to it. A tree of one node has no record: its levels are null."""
    own = [c for c in tops.columns if c not in ("digest", "path")]
    starts = tops.select(*own, F.lit(0).cast("long").alias("segment"), "digest", F.col("path").cast(PATH).alias("path"))
    level_of = F.greatest(F.ceil(height(F.col("n")) / lift) - 1, F.lit(0))
    at = starts.where("false")
    for level in reversed(range(1, len(store))):
        met = starts.where(level_of == level).union(at).join(store[level], "digest")
        met = met.select(*own, "segment", "levels", "path", F.posexplode(F.col("levels")[0]).alias("child", "digest"))
        at = written(met.select(*own, (F.col("segment") * ARITY ** lift + F.col("child")).alias("segment"), "digest",
                                F.concat("path", way(F.col("levels"), F.col("child"))).alias("path")), "merkle-descent")
    low = starts.where(level_of == 0).union(at)
    if not store:
        return low.withColumn("levels", F.lit(None).cast("array<array<string>>"))
    return low.join(store[0], "digest", "left")


def proofs(leaves: DataFrame, tops: DataFrame, store: list[DataFrame], lift: int) -> DataFrame:
    """leaves (group, rank, ...) with the columns of tops (group, digest, n, path, ...) of their tree, `path` being the
    way from where the top's own path began down to the leaf."""
    segments = descended(tops, store, lift).withColumnRenamed("group", "__group").drop("digest", "n")
    size = ARITY ** lift
    return (leaves.join(segments, F.col("group").eqNullSafe(F.col("__group")) & (F.floor(F.col("rank") / size) == F.col("segment")))
            .withColumn("path", F.concat("path", way(F.col("levels"), F.col("rank") % size)))
            .drop("__group", "segment", "levels"))


def folded(start: Column, path: Column) -> Column:
    """Digest that `start` becomes with the siblings of a path, leaf first."""
    return F.aggregate(path, start, lambda d, s: digest(F.concat(
        F.slice(s["others"], F.lit(1), s["digit"]), F.array(d), F.slice(s["others"], s["digit"] + 1, F.lit(ARITY)))))


def manifest(docs: DataFrame, lift: int = LIFT) -> DataFrame:
    """(doc_id, lang, rank, leaf, tampered_leaf, subroot, root, path) of every row of docs: path is its proof, a struct
    (digit, others) for each level, leaf first; tampered_leaf is null where nothing is tampered with."""
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c) if c != "n_chars" else F.col(c).cast("long") + 1 for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("group"), leaf(fields).alias("digest"),
                             F.when(hit & F.col("n_chars").isNotNull(), leaf(changed)).alias("tampered_leaf")))
    leaves = ranked(rows, "group", ["doc_id", "digest", KEY], "merkle-leaves")
    subroots, store = stored(leaves.select("group", "rank", "n", "digest"), lift)
    languages = ranked(subroots.select(F.lit(0).alias("all"), F.col("group").alias("lang"), F.col("n").alias("leaves"), "digest"),
                       "all", ["lang"], "merkle-subroots").withColumnRenamed("all", "group")
    root, top_store = stored(languages.select("group", "rank", "n", "digest"), lift)
    root = root.select("group", "n", "digest", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = (proofs(languages.drop("n"), root, top_store, lift)
            .select(F.col("lang").alias("group"), F.col("leaves").alias("n"), "digest", F.col("digest").alias("subroot"), "root", "path"))
    return (proofs(leaves.drop("n"), written(tops, "merkle-tops"), store, lift)
            .select("doc_id", F.col("group").alias("lang"), "rank", F.col("digest").alias("leaf"), "tampered_leaf", "subroot", "root",
                    F.reverse("path").alias("path")))


def verified(proved: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows of manifest()."""
    proved = proved.withColumns({
        "proof_sha256": digest(F.flatten(F.transform("path", lambda s: s["others"]))),
        "folded_root": folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))})
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """DuckDB twin of verified(manifest()), for ARITY 2: trees level by level, proofs by sibling ranks."""
    def enc(c):
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    def h(n_chars):
        return f"sha256({' || '.join(enc(n_chars if f == 'n_chars' else f) for f in FIELDS)})"

    def tree(name, leaves):
        return f"""
{name} AS (
  SELECT g, 0 AS l, r, n, d FROM {leaves}
  UNION ALL
  SELECT a.g, a.l + 1, a.r // 2, (a.n + 1) // 2, sha256(a.d || coalesce(b.d, ''))
  FROM {name} a LEFT JOIN {name} b ON a.g = b.g AND b.r = a.r + 1 WHERE a.r % 2 = 0 AND a.n > 1)"""

    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    return f"""
WITH RECURSIVE src AS (
  SELECT doc_id, lang, {h('n_chars')} AS leaf, {h('n_chars + 1')} AS other,
         n_chars IS NOT NULL AND coalesce(({crc}) % {TAMPER_EVERY} = 0, false) AS hit FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (SELECT s.*, leaf AS d, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n
           FROM src s JOIN langs ON s.lang IS NOT DISTINCT FROM langs.lang),
{tree('low', 'leaves')},
subs AS (SELECT l.g, l.d AS subroot, l.l AS up FROM low l WHERE n = 1),
tops AS (SELECT 0 AS g, subs.g AS r, (SELECT count(*) FROM langs) AS n, subroot AS d FROM subs),
{tree('high', 'tops')},
root AS (SELECT d AS root, l AS up FROM high WHERE n = 1),
steps AS (
  SELECT x.doc_id, x.g, x.r, s.l AS l, s.d AS other, (x.r >> s.l) & 1 AS digit
  FROM leaves x JOIN low s ON s.g = x.g AND s.r = xor(x.r >> s.l, 1)
  UNION ALL
  SELECT x.doc_id, x.g, x.r, 100 + s.l, s.d, (x.g >> s.l) & 1 FROM leaves x JOIN high s ON s.r = xor(x.g >> s.l, 1)),
places AS (
  SELECT x.g, x.r, l, coalesce(p.other, '') AS other, coalesce(p.digit, 0) AS digit
  FROM (SELECT g, r, unnest(range((SELECT up FROM subs WHERE subs.g = leaves.g))) AS l FROM leaves
        UNION ALL SELECT g, r, 100 + unnest(range((SELECT up FROM root))) FROM leaves) x
  LEFT JOIN steps p USING (g, r, l)),
listed AS (SELECT g, r, list(struct_pack(d := digit, o := other) ORDER BY l) AS path, sha256(string_agg(other, '' ORDER BY l)) AS proof FROM places GROUP BY g, r),
done AS (
  SELECT x.doc_id, x.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN hit THEN x.other ELSE x.leaf END, list_transform(coalesce(path, []), lambda s: s.d::VARCHAR || s.o)),
                     lambda a, s: CASE WHEN s[1] = '1' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM leaves x JOIN subs USING (g) CROSS JOIN root LEFT JOIN listed USING (g, r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
