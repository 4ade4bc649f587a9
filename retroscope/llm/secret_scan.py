"""Secret scans: candidates by pattern, judged by how many owners of the whole corpus hold the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.session import cut_lineage

# Kind, pattern, group that holds the value, condition on the value.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, r"^.{6,}$"),
    ("access", r"AKIA[A-Z0-9]+", 0, r"^.{20,}$"),
    ("hex", r"[0-9a-f]+", 0, r"^.{24,}$"),
]
# what the method adds: long mixed strings, reported only where few owners hold them
ADDED_KINDS = [("generic", r"[A-Za-z0-9+/_=-]{32,}", 0, r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")]
KINDS = [*BASE_KINDS, *ADDED_KINDS]
# a cheap test that holds for every text with a fitting match
_HINTS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "generic": r"[A-Za-z0-9+/_=-]{32}"}
FEW_OWNERS = 2


def _pieces(text: Column, kind: str, pattern: str, group: int, fits: str) -> Column:
    """Per match: code points since the match before, its own, and the digest of a fitting value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), whole.alias("hit"), value.alias("value"))
    each = F.transform(zipped, lambda z: F.struct(
        F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"),
        F.when(z["value"].rlike(fits), F.sha2(z["value"], 256)).alias("digest")))
    return F.when(text.rlike(_HINTS[kind]), each)


def secret_candidates(docs: DataFrame, text: str = "text", id: str = "doc_id", repository: Column | None = None,
                      owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id) and their candidates (row, doc_id, kind, start, end, digest, n_owners,
    n_repositories, owner_specific).

    One scan turns each text into lengths and digests; everything after works on those. Offsets are
    code points, end exclusive, from a running sum over the matches of one text and kind. Values are
    counted by distinct owner and repository over the whole corpus: copies inside one task and then
    inside one repository collapse first, so a value that a third of all rows share is one row each.
    Null text counts as empty; a null owner or repository counts as one of its own; repeated rows are
    rows of their own; an empty table gives two empty tables; other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    scanned = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"),
        F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"),
        *[_pieces(t, *k).alias(k[0]) for k in KINDS]))
    hits = None
    for no, (kind, *_) in enumerate(KINDS):
        one = (scanned.where(F.col(kind).isNotNull())
               .select("row", "doc_id", "owner", "repository", F.lit(no).alias("no"), F.posexplode(kind).alias("pos", "m"))
               .select("row", "doc_id", "owner", "repository", "no", "pos", "m.*"))
        hits = one if hits is None else hits.unionByName(one)
    so_far = Window.partitionBy("row", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = (hits.withColumn("end", F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(so_far))
              .where(F.col("digest").isNotNull()).withColumn("start", F.col("end") - F.col("hit")))
    placed = cut_lineage(placed.select("row", "doc_id", "no", "start", "end", "digest", "owner", "repository"))
    held = placed.groupBy("digest", "owner", "repository").count()
    owners = held.groupBy("digest", "owner").agg(F.count("*").alias("n")).groupBy("digest").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    found = placed.join(owners, "digest").withColumn("owner_specific", F.col("n_owners") <= FEW_OWNERS)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return scanned.select("row", "doc_id"), found.withColumn("kind", F.element_at(names, F.col("no") + 1))


def secret_spans(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of ``docs``: all base spans, and
    of the added kinds those whose value few owners hold."""
    rows, found = secret_candidates(docs, **how)
    n_base = len(BASE_KINDS)
    shown = found.where((F.col("no") < n_base) | F.col("owner_specific"))
    listed = shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind"))).alias("s"))
    say = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(F.coalesce("s", F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")), lambda x: x["no"] < n_base)
    count = lambda no: F.size(F.filter(base, lambda x: x["no"] == no)).cast("bigint")
    return rows.join(listed, "row", "left").select(
        "doc_id",
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(F.array_join(F.transform(base, say), ","), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("s", say), ","), F.lit("")).alias("spans"))


def _sql() -> str:
    """The same in plain SQL."""
    parts = []
    for no, (kind, pattern, group, fits) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        cond = {"assign": "length(v) >= 6", "access": "length(v) >= 20", "hex": "length(v) >= 24",
                "generic": "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"}[kind]
        parts.append(f"""SELECT rid, doc_id, source, lang, {no} AS no, '{kind}' AS kind, e - length(h) AS s, e, v FROM (
          SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
            SELECT rid, doc_id, source, lang, unnest(range(len(hs))) AS i, unnest(hs) AS h, unnest(vs) AS v, unnest(gs[1:len(hs)]) AS g FROM (
              SELECT *, regexp_extract_all(text, '{p}') AS hs, regexp_extract_all(text, '{p}', {group}) AS vs,
                string_split_regex(text, '{p}') AS gs FROM d))) WHERE {cond}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source,
  concat_ws('/', source, lang) AS lang FROM documents),
c AS ({' UNION ALL '.join(parts)}),
o AS (SELECT v, count(DISTINCT source) AS n FROM c GROUP BY v),
f AS (SELECT c.*, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS w FROM c JOIN o USING (v) WHERE no < {len(BASE_KINDS)} OR n <= {FEW_OWNERS}),
g AS (SELECT rid, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS k, count(*) FILTER (no = 2) AS x,
  string_agg(w, ',' ORDER BY s, no) FILTER (no < {len(BASE_KINDS)}) AS b, string_agg(w, ',' ORDER BY s, no) AS w FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(w, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP9_SQL = _sql()
