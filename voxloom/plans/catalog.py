"""Every query of the library by name, with its SQL.

Doubles are rounded to six places on both sides where sums may be taken in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import clusterquality, contingency, evaluation, frames, labels, manifests, pairing, pooling
from voxloom.plans.views import SQL, Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "global_metrics"


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def put(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = (SQL + ", " + sql.strip().removeprefix("WITH").strip() if sql.strip().startswith("WITH") else SQL + sql) if views else sql
        return plan

    return put


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


# ---- pairing and manifests -----------------------------------------------------------------------

STEM = r"lower(regexp_replace(regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9]+', '', 'g'))"


@query(
    "pair_by_stem",
    f"""WITH l AS (SELECT {STEM.format("p")} AS key, max(p) AS left_path FROM (SELECT 'wav/' || replace(p_name, ' ', '_') || '.wav' AS p FROM part) GROUP BY 1),
r AS (SELECT {STEM.format("p")} AS key, max(p) AS right_path FROM (SELECT 'tg/' || upper(replace(p_name, ' ', '-')) || '.TextGrid' AS p FROM part WHERE p_size > 10) GROUP BY 1)
SELECT l.key, left_path, right_path FROM l JOIN r ON l.key = r.key""",
    views=False,
)
def pair_by_stem(v: Views) -> DataFrame:
    part = v.table("part")
    wav = part.select(F.concat(F.lit("wav/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".wav")).alias("path"))
    grid = part.filter("p_size > 10").select(F.concat(F.lit("tg/"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(".TextGrid")).alias("path"))
    return pairing.pair_by_stem(wav, grid)


@query("file_manifest", "SELECT file_id::BIGINT AS file_id, audio_path FROM files")
def file_manifest(v: Views) -> DataFrame:
    return manifests.file_manifest(v.files())


@query(
    "segment_manifest",
    """SELECT file_id, segment_id, start, peak, "end", 'sbs' AS segmentation_method, '{"delta":0.01}' AS segmentation_kwargs_ref,
    count(*) OVER (PARTITION BY file_id)::INT AS num_segments FROM fsegs""",
)
def segment_manifest(v: Views) -> DataFrame:
    spans = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "start", "peak", "end"))), lambda s: F.struct(s["start"].alias("start"), s["peak"].alias("peak"), s["end"].alias("end")))
    nested = v.fsegs().groupBy("file_id").agg(spans.alias("segments"))
    nested = nested.withColumns({"segmentation_method": F.lit("sbs"), "segmentation_kwargs": F.create_map(F.lit("delta"), F.lit(0.01))})
    return manifests.segment_manifest(nested)


@query(
    "corpus_join",
    """SELECT s.file_id, s.segment_id, s.start, s.peak, s."end", f.audio_path, o.o_orderpriority AS preset, p.s_nationkey AS cluster_label, l.primary_label
    FROM fsegs s LEFT JOIN files f ON s.file_id = f.file_id LEFT JOIN orders o ON o.o_orderkey = s.file_id
    LEFT JOIN (SELECT file_id, segment_id, s_nationkey FROM fsegs JOIN supplier ON s_suppkey = suppkey WHERE s_acctbal > 0) p ON p.file_id = s.file_id AND p.segment_id = s.segment_id
    LEFT JOIN (SELECT file_id, segment_id, 'label ' || suppkey % 7 AS primary_label FROM fsegs WHERE suppkey % 3 > 0) l ON l.file_id = s.file_id AND l.segment_id = s.segment_id""",
)
def corpus_join(v: Views) -> DataFrame:
    segs = v.fsegs()
    found = segs.join(v.table("supplier").filter("s_acctbal > 0"), F.col("suppkey") == F.col("s_suppkey")).select("file_id", "segment_id", F.col("s_nationkey").alias("cluster_label"))
    named = segs.filter("suppkey % 3 > 0").select("file_id", "segment_id", F.concat(F.lit("label "), (F.col("suppkey") % 7).cast("string")).alias("primary_label"))
    embedded = v.table("orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("preset"))
    out = manifests.join_corpus(segs.drop("suppkey"), v.files(), embedded, found, named)
    return out.select("file_id", "segment_id", "start", "peak", "end", "audio_path", "preset", "cluster_label", "primary_label")


@query("discovery_manifest", """SELECT file_id, segment_id, segment_id AS embedding_id, start, peak, "end", (suppkey % 10)::INT AS cluster_label FROM fsegs""")
def discovery_manifest(v: Views) -> DataFrame:
    rows = manifests.discovery_manifest(v.fsegs().withColumn("cluster_label", F.col("suppkey") % 10))
    return rows.select("file_id", "segment_id", "embedding_id", "start", "peak", "end", "cluster_label")


@query("label_manifest", "SELECT file_id, to_json(list(text ORDER BY interval_idx)) AS tg_labels FROM tiers GROUP BY file_id")
def label_manifest(v: Views) -> DataFrame:
    rows = v.tiers().groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("interval_idx", "text"))), lambda x: x["text"]).alias("tg_labels"))
    return manifests.label_manifest(rows)


@query(
    "embedding_lookup",
    """SELECT file_id * 50 + 49 - frame AS ord, file_id, frame AS segment_id, vec AS embedding FROM frames""",
)
def embedding_lookup(v: Views) -> DataFrame:
    rows = v.frames().select("file_id", F.col("frame").alias("segment_id"), F.col("vec").alias("embedding"))
    asked = rows.select((F.col("file_id") * 50 + 49 - F.col("segment_id")).alias("ord"), "file_id", "segment_id")
    return manifests.lookup(rows, asked)


# ---- labels --------------------------------------------------------------------------------------

LABELS = """WITH m AS (
  SELECT s.file_id, s.segment_id, s.peak, t.xmin, t.xmax, t.interval_idx AS k, t.text AS label, least(s."end", t.xmax) - greatest(s.start, t.xmin) AS ov
  FROM segs s JOIN tiers t ON s.file_id = t.file_id AND s.start < t.xmax AND t.xmin < s."end"),
g AS (
  SELECT file_id, segment_id, list(label ORDER BY k) FILTER (ov >= 0.03 OR ov / greatest(1e-6, xmax - xmin) >= 0.5) AS tg_labels,
         arg_max(label, (ov, -k)) AS top, arg_min(label, k) FILTER (peak BETWEEN xmin AND xmax) AS at_peak FROM m GROUP BY ALL),
l AS (
  SELECT s.file_id, s.segment_id, coalesce(g.tg_labels, []) AS tg_labels, coalesce(top, '') AS primary_label_max_overlap, coalesce(at_peak, '') AS primary_label_peak
  FROM segs s LEFT JOIN g ON g.file_id = s.file_id AND g.segment_id = s.segment_id)
SELECT file_id, segment_id, array_to_string(tg_labels, ' ') AS tier_labels_concat, {0} AS primary_label, primary_label_peak, primary_label_max_overlap, len(tg_labels) > 0 AS label_attached FROM l"""

for _mode, _sql in (("sequence", "array_to_string(tg_labels, ' ')"), ("max_overlap", "primary_label_max_overlap"), ("nucleus", "primary_label_peak"), ("first", "coalesce(tg_labels[1], '')")):

    @query(f"label_{_mode}", LABELS.format(_sql))
    def label_mode(v: Views, mode: str = _mode) -> DataFrame:
        rows = labels.attach_labels(v.segs(), v.tiers(), mode=mode, width=7 * 86_400.0 if mode == "first" else None)
        return rows.select("file_id", "segment_id", "tier_labels_concat", "primary_label", "primary_label_peak", "primary_label_max_overlap", "label_attached")


# ---- evaluation ----------------------------------------------------------------------------------


@query("boundary_set", """SELECT DISTINCT file_id, t FROM (SELECT file_id, start AS t FROM segs UNION ALL SELECT file_id, "end" FROM segs)""")
def boundary_set(v: Views) -> DataFrame:
    return evaluation.boundary_set(v.segs())


REFERENCE = """WITH ref AS (SELECT file_id, start, "end", segment_id % 4 > 0 AS active FROM segs),
pred AS (SELECT file_id, start + 1800 AS start, "end" + (segment_id % 5) * 1200 AS "end" FROM segs WHERE segment_id % 6 < 5)"""


def reference(v: Views) -> DataFrame:
    return v.segs().select("file_id", "start", "end", (F.col("segment_id") % 4 > 0).alias("active"))


def predicted(v: Views) -> DataFrame:
    return v.segs().filter("segment_id % 6 < 5").select("file_id", (F.col("start") + 1800).alias("start"), (F.col("end") + (F.col("segment_id") % 5) * 1200).alias("end"))


COUNTS = ("file_id", "TP", "Ins", "Del", "TER")


@query(
    "boundary_eval",
    REFERENCE
    + """, p AS (SELECT DISTINCT file_id, t AS p FROM (SELECT file_id, start AS t FROM pred UNION ALL SELECT file_id, "end" FROM pred)),
r AS (SELECT DISTINCT file_id, t AS r, active FROM (SELECT file_id, start AS t, active FROM ref UNION ALL SELECT file_id, "end", active FROM ref)),
n AS (SELECT p.file_id, p, r, active, row_number() OVER (PARTITION BY p.file_id, p ORDER BY abs(p - r), NOT active, r) AS a,
  row_number() OVER (PARTITION BY p.file_id, r, active ORDER BY abs(p - r), p) AS b FROM p JOIN r ON p.file_id = r.file_id AND abs(p - r) <= 3600),
h AS (SELECT * FROM n WHERE a = 1 AND b = 1),
c AS (SELECT f.file_id,
  (SELECT count(*) FROM h WHERE h.file_id = f.file_id AND active) AS TP,
  (SELECT count(*) FROM p WHERE p.file_id = f.file_id AND NOT EXISTS (SELECT 1 FROM h WHERE h.file_id = p.file_id AND h.p = p.p)) AS Ins,
  (SELECT count(*) FROM r WHERE r.file_id = f.file_id AND active AND NOT EXISTS (SELECT 1 FROM h WHERE h.file_id = r.file_id AND h.r = r.r AND h.active)) AS Del
  FROM (SELECT DISTINCT file_id FROM segs) f)
SELECT file_id, TP, Ins, Del, round((Ins + Del) / greatest(TP + Del, 1), 6) AS TER FROM c""",
)
def boundary_eval(v: Views) -> DataFrame:
    ref = evaluation.boundary_set(reference(v), key=("file_id", "active"))
    return rounded(evaluation.evaluate_boundaries(evaluation.boundary_set(predicted(v)), ref, 3600.0).select(*COUNTS), "TER")


@query(
    "nuclei_eval",
    """WITH pk AS (SELECT file_id, idx AS ord, t FROM signal WHERE v > 60),
iv AS (SELECT file_id, start AS xmin, "end" AS xmax, row_number() OVER (PARTITION BY file_id ORDER BY start, "end") AS k FROM segs WHERE n > 1),
m AS (SELECT pk.file_id, t, k, row_number() OVER (PARTITION BY pk.file_id, k ORDER BY ord) AS rn FROM pk JOIN iv ON pk.file_id = iv.file_id AND t >= xmin - 600 AND t <= xmax + 600),
val AS (SELECT file_id, t, bool_or(rn > 1) AS e FROM m GROUP BY ALL),
f AS (SELECT DISTINCT file_id FROM (SELECT file_id FROM pk UNION ALL SELECT file_id FROM iv)),
c AS (SELECT file_id, (SELECT count(DISTINCT k) FROM m WHERE m.file_id = f.file_id) AS TP,
  (SELECT count(*) FROM val WHERE val.file_id = f.file_id AND e) + (SELECT count(*) FROM pk WHERE pk.file_id = f.file_id AND NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = pk.file_id AND m.t = pk.t)) AS Ins,
  (SELECT count(*) FROM iv WHERE iv.file_id = f.file_id) AS n FROM f)
SELECT file_id, TP, Ins, n - TP AS Del, round(CASE WHEN n > 0 THEN (Ins + n - TP) / n ELSE 0 END, 6) AS TER FROM c""",
)
def nuclei_eval(v: Views) -> DataFrame:
    peaks = v.signal().filter("v > 60").select("file_id", F.col("idx").alias("ord"), "t")
    spans = v.segs().filter("n > 1").select("file_id", F.col("start").alias("xmin"), F.col("end").alias("xmax"))
    return rounded(evaluation.evaluate_nuclei(peaks, spans, 600.0).select(*COUNTS), "TER")


@query(
    "span_iou_best",
    REFERENCE
    + """, m AS (SELECT p.file_id, p.start, p."end", r.start AS r0, r."end" AS r1,
  coalesce(greatest(least(p."end", r."end") - greatest(p.start, r.start), 0) / nullif(greatest(p."end", r."end") - least(p.start, r.start), 0), 0) AS iou
  FROM pred p LEFT JOIN ref r ON p.file_id = r.file_id AND p.start < r."end" AND r.start < p."end")
SELECT file_id, start, "end", round(max(iou), 6) AS iou, arg_max(r0, (iou, -r0, -r1)) AS ref_start, arg_max(r1, (iou, -r0, -r1)) AS ref_end FROM m GROUP BY file_id, start, "end" """,
)
def span_iou_best(v: Views) -> DataFrame:
    return rounded(evaluation.best_span_overlap(predicted(v), reference(v)), "iou")


def as_results(v: Views) -> DataFrame:
    """Orders as evaluated files, each with the results of two tiers; one in eleven lacks the second."""
    o = v.table("orders").select(F.concat(F.lit("eval/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"), F.col("o_orderkey").alias("k"))
    result = lambda a, b, c, d: F.struct(a.alias("TP"), b.alias("Ins"), c.alias("Del"), d.alias("Sub"), ((b + c) / F.greatest(a + c, F.lit(1))).alias("TER"))
    k = F.col("k")
    return o.select("path", result(k % 9, k % 4, k % 3, F.lit(None).cast("long")).alias("nuclei"), F.when(k % 11 > 0, result(k % 7, k % 5, k % 2, k % 3)).alias("syllable_spans"))


RESULTS = """WITH ev AS (
  SELECT o_orderkey::VARCHAR AS file_id, 'nuclei' AS eval_method, o_orderkey % 9 AS TP, o_orderkey % 4 AS Ins, o_orderkey % 3 AS Del, NULL::BIGINT AS Sub FROM orders
  UNION ALL SELECT o_orderkey::VARCHAR, 'syllable_spans', o_orderkey % 7, o_orderkey % 5, o_orderkey % 2, o_orderkey % 3 FROM orders WHERE o_orderkey % 11 > 0)"""


@query("eval_flatten", RESULTS + " SELECT *, round((Ins + Del) / greatest(TP + Del, 1), 6) AS TER FROM ev")
def eval_flatten(v: Views) -> DataFrame:
    return rounded(evaluation.flatten(as_results(v), ["nuclei", "syllable_spans"]), "TER")


@query(
    "eval_aggregate",
    RESULTS
    + """, s AS (SELECT eval_method, sum(TP) AS tp, sum(Ins) AS i, sum(Del) AS d, coalesce(sum(Sub), 0) AS s FROM ev GROUP BY 1),
q AS (SELECT *, (tp + d + s)::BIGINT AS total, tp / (tp + i + s) AS p, tp / (tp + d + s) AS r FROM s)
SELECT 'orders' AS dataset, eval_method, round(tp / total, 6) AS TP, round(i / total, 6) AS Ins, round(d / total, 6) AS Del, round(s / total, 6) AS Sub, round((i + d + s) / total, 6) AS TER,
round(p, 6) AS Precision, round(r, 6) AS Recall, round(2 * p * r / (p + r), 6) AS F1, total AS Total FROM q""",
)
def eval_aggregate(v: Views) -> DataFrame:
    rows = evaluation.aggregate(evaluation.flatten(as_results(v), ["nuclei", "syllable_spans"]), "orders")
    return rounded(rows, "TP", "Ins", "Del", "Sub", "TER", "Precision", "Recall", "F1")


WORDS = """WITH w AS (SELECT doc_id, unnest(generate_series(1, len(ws)))::BIGINT AS interval_idx, unnest(ws) AS text FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))"""


def words(v: Views) -> DataFrame:
    """The words of all documents, standing in for the intervals of a tier."""
    rows = v.table("documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("interval_idx"), "text")


@query(
    "vowel_filter",
    WORDS
    + f""", s AS (SELECT *, upper(replace(text, 'ß', 'SS')) AS up FROM w)
SELECT doc_id, interval_idx, text FROM s WHERE text IN {evaluation.VOWELS} OR up IN {evaluation.VOWELS} OR lower(text) IN {evaluation.VOWELS} OR regexp_replace(up, '[^a-zA-Z]', '', 'g') IN {evaluation.VOWELS}""",
    views=False,
)
def vowel_filter(v: Views) -> DataFrame:
    return evaluation.vocalic_intervals(words(v))


@query(
    "marker_split",
    WORDS + " SELECT doc_id, interval_idx, text, NOT (trim(text) = '' OR " + " OR ".join(f"contains(text, '{m}')" for m in evaluation.MARKERS) + ") AS active FROM w",
    views=False,
)
def marker_split(v: Views) -> DataFrame:
    return evaluation.syllable_intervals(words(v))


# ---- clusters against labels -----------------------------------------------------------------------

TABLE = """WITH t0 AS (SELECT source AS cluster, lang AS label, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang <> '' GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY cluster)::BIGINT AS n_cluster, sum(n) OVER (PARTITION BY label)::BIGINT AS n_label FROM t0),
f AS (SELECT *, n / n_cluster AS p, n / n_label AS r, 2 * (n / n_cluster) * (n / n_label) / (n / n_cluster + n / n_label) AS f1 FROM t),
cl AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1),
lb AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) = 1)"""


def scores(v: Views) -> contingency.ClusterScores:
    return contingency.score(v.table("documents"), "source", "lang")


@query("contingency", TABLE + " SELECT cluster, label, n, n_cluster, n_label FROM t", views=False)
def contingency_table(v: Views) -> DataFrame:
    return contingency.contingency(v.table("documents"), "source", "lang")


@query("cluster_metrics", TABLE + " SELECT cluster, label AS majority_label, n_cluster AS support, n AS majority_count, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(p, 6) AS purity FROM cl", views=False)
def cluster_metrics(v: Views) -> DataFrame:
    return rounded(scores(v).clusters, "precision", "recall", "f1", "purity")


@query("label_metrics", TABLE + " SELECT label, cluster AS best_cluster, n_label AS support, n AS best_count, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(r, 6) AS purity FROM lb", views=False)
def label_metrics(v: Views) -> DataFrame:
    return rounded(scores(v).labels, "precision", "recall", "f1", "purity")


@query(
    "global_metrics",
    TABLE
    + """, n AS (SELECT sum(n)::BIGINT AS n FROM t), mi AS (SELECT sum(t.n / n.n * ln(t.n * n.n / (n_cluster * n_label))) AS m FROM t, n),
h AS (SELECT -sum(n_label / n.n * ln(n_label / n.n)) AS h, count(*) AS k, sum(lb.n) AS b FROM lb, n), c AS (SELECT count(*) AS k, sum(n) AS b, avg(f1) AS a, sum(f1 * n_cluster) / sum(n_cluster) AS w FROM cl)
SELECT n.n, c.k AS n_clusters, h.k AS n_labels, round(c.b / n.n, 6) AS cluster_purity, round(h.b / n.n, 6) AS label_purity, round(m, 6) AS mutual_information, round(h, 6) AS label_entropy,
round(m / h, 6) AS nmi, round(a, 6) AS macro_f1, round(w, 6) AS weighted_f1 FROM n, mi, h, c""",
    views=False,
)
def global_metrics(v: Views) -> DataFrame:
    return rounded(scores(v).overall, "cluster_purity", "label_purity", "mutual_information", "label_entropy", "nmi", "macro_f1", "weighted_f1")


# ---- pooling ---------------------------------------------------------------------------------------

SPANS = """WITH sp AS (SELECT file_id, k AS segment_id, k * 0.117::DOUBLE AS start, k * 0.117::DOUBLE + 0.064::DOUBLE AS peak, k * 0.117::DOUBLE + 0.1324::DOUBLE AS "end" FROM (SELECT DISTINCT file_id FROM frames), (SELECT unnest(range(8)) AS k)),
b AS (SELECT sp.*, n, least(greatest({0}(start * 50)::INT, 0), n - 1) AS a, least({0}("end" * 50)::INT, n) AS z FROM sp JOIN (SELECT file_id, max(frame) + 1 AS n FROM frames GROUP BY 1) c ON c.file_id = sp.file_id),
x AS (SELECT b.file_id, segment_id, unnest(generate_series(1, len(vec))) AS dim, unnest(vec) AS x FROM b JOIN frames f ON f.file_id = b.file_id AND frame >= a AND frame < greatest(z, a + 1)),
g AS (SELECT file_id, segment_id, dim, {1}(x) AS x FROM x GROUP BY ALL)
SELECT file_id, segment_id, list(round(x, 6) + 0.0::DOUBLE ORDER BY dim) AS embedding FROM g GROUP BY file_id, segment_id"""


def spans(v: Views) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    start = F.col("k") * 0.117
    rows = v.frames().select("file_id").distinct().select("file_id", k)
    return rows.select("file_id", F.col("k").cast("long").alias("segment_id"), start.alias("start"), (start + 0.064).alias("peak"), (start + 0.1324).alias("end"))


def pooled(v: Views, method: str, **options: str) -> DataFrame:
    rows = pooling.get_pooler(method)(v.frames(), spans(v), 50.0, **options)
    return rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6) + F.lit(0.0)))  # no -0.0


for _name, _method, _agg, _bounds in (("pool_mean", "mean", "avg", "trunc"), ("pool_max", "max", "max", "trunc"), ("pool_median", "median", "median", "trunc"), ("pool_mean_rounded", "mean", "avg", "round")):

    @query(_name, SPANS.format("round_even" if _bounds == "round" else "trunc", _agg).replace("round_even(start * 50)", "round_even(start * 50, 0)").replace('round_even("end" * 50)', 'round_even("end" * 50, 0)'))
    def pool_any(v: Views, method: str = _method, bounds: str = _bounds) -> DataFrame:
        return pooled(v, method, bounds=bounds)


@query(
    "pool_onc",
    SPANS.split("b AS")[0]
    + """o AS (SELECT sp.*, n, unnest([0, 1, 2]) AS part, unnest([start + 0.3::DOUBLE * (peak - start), peak, peak + 0.7::DOUBLE * ("end" - peak)]) AS t FROM sp JOIN (SELECT file_id, max(frame) + 1 AS n FROM frames GROUP BY 1) c ON c.file_id = sp.file_id),
p AS (SELECT o.file_id, segment_id, part, vec FROM o JOIN frames f ON f.file_id = o.file_id AND f.frame = least(greatest(round_even(t * 50, 0)::INT, 0), n - 1))
SELECT file_id, segment_id, list_transform(flatten(list(vec ORDER BY part)), lambda x: round(x, 6) + 0.0::DOUBLE) AS embedding FROM p GROUP BY file_id, segment_id""",
)
def pool_onc(v: Views) -> DataFrame:
    return pooled(v, "onc")


# ---- frames ----------------------------------------------------------------------------------------

NORM = "sqrt(list_dot_product({0}, {0}) + 1e-8)"


@query("frame_norm", f"SELECT file_id, frame, round({NORM.format('vec')}, 6) AS norm FROM frames")
def frame_norm(v: Views) -> DataFrame:
    return rounded(frames.norms(v.frames()), "norm")


@query("norm_mask", "SELECT file_id, frame, sqrt(list_dot_product(vec[1:32], vec[1:32]) + 1e-8) >= 0.7 AS active FROM frames")
def norm_mask(v: Views) -> DataFrame:
    return frames.active_frames(v.frames().withColumn("vec", F.slice("vec", 1, 32)), 0.7)


ADJACENT = f"""WITH ad AS (SELECT *, lag(vec) OVER (PARTITION BY file_id ORDER BY frame) AS b FROM frames),
si AS (SELECT file_id, frame, list_dot_product(vec, b) / ({NORM.format("vec")} * {NORM.format("b")}) AS similarity FROM ad)"""


@query("adjacent_cosine", ADJACENT + " SELECT file_id, frame, round(similarity, 6) AS similarity FROM si")
def adjacent_cosine(v: Views) -> DataFrame:
    return rounded(frames.adjacent_cosine(v.frames()), "similarity")


@query(
    "stable_frame",
    SPANS.split("x AS")[0].format("round_even", "").replace("(start * 50)", "(start * 50, 0)").replace('("end" * 50)', '("end" * 50, 0)')
    + """i AS (SELECT b.file_id, segment_id, start, "end", frame, vec, lag(vec) OVER (PARTITION BY b.file_id, segment_id ORDER BY frame) AS pv FROM b JOIN frames f ON f.file_id = b.file_id AND frame >= a AND frame < greatest(z, a + 1)),
l AS (SELECT *, CASE WHEN pv IS NOT NULL THEN list_dot_product(vec, pv) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(pv, pv))) END AS li FROM i),
n AS (SELECT *, lead(li) OVER (PARTITION BY file_id, segment_id ORDER BY frame) AS ne FROM l)
SELECT file_id, segment_id, round(start, 6) AS start, round("end", 6) AS "end", round(arg_max(frame, (coalesce((li + ne) / 2, li, ne, 0), -frame)) / 50.0, 6) AS peak FROM n GROUP BY file_id, segment_id, start, "end" """,
)
def stable_frame(v: Views) -> DataFrame:
    return rounded(frames.stable_peaks(v.frames(), spans(v).select("file_id", "segment_id", "start", "end"), 50.0), "start", "end", "peak")


@query(
    "ssm_envelope",
    """WITH m AS (SELECT a.file_id, a.frame, list_dot_product(a.vec, b.vec) / greatest(sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)), 1e-8) AS s FROM frames a JOIN frames b ON a.file_id = b.file_id),
g AS (SELECT file_id, frame, avg(s) AS m FROM m GROUP BY ALL)
SELECT file_id, frame, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w), 6) AS v FROM g WINDOW w AS (PARTITION BY file_id)""",
)
def ssm_envelope(v: Views) -> DataFrame:
    return rounded(frames.self_similarity_envelope(v.frames()), "v")


@query("minmax_norm", "SELECT file_id, idx, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS v FROM signal WINDOW w AS (PARTITION BY file_id)")
def minmax_norm(v: Views) -> DataFrame:
    return rounded(frames.normalized(v.signal()).select("file_id", "idx", "v"), "v")


@query(
    "rms_window",
    """WITH r AS (SELECT file_id, idx, sum(v * v) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS s FROM signal)
SELECT file_id, (idx // 4)::BIGINT AS frame, round(sqrt(s / 16), 6) AS v FROM r WHERE idx % 4 = 0""",
)
def rms_window(v: Views) -> DataFrame:
    return rounded(frames.moving_rms(v.signal(), 16, 4), "v")


@query(
    "smooth_window",
    """SELECT file_id, idx, round(.1 * coalesce(lag(v, 2) OVER w, 0) + .2 * coalesce(lag(v, 1) OVER w, 0) + .4 * v + .2 * coalesce(lead(v, 1) OVER w, 0) + .1 * coalesce(lead(v, 2) OVER w, 0), 6) AS v
FROM signal WINDOW w AS (PARTITION BY file_id ORDER BY idx)""",
)
def smooth_window(v: Views) -> DataFrame:
    return rounded(frames.smoothed(v.signal(), [0.1, 0.2, 0.4, 0.2, 0.1]).select("file_id", "idx", "v"), "v")


@query("average_window", "SELECT file_id, idx, round(avg(v) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM signal")
def average_window(v: Views) -> DataFrame:
    return rounded(frames.moving_average(v.signal(), 5).select("file_id", "idx", "v"), "v")


# ---- attention -------------------------------------------------------------------------------------

ATTENTION = """WITH att AS (SELECT file_id, frame, unnest(generate_series(0, 3)) AS head, unnest(list_transform(vec[1:4], lambda x: abs(x))) AS w FROM frames),
ed AS (SELECT file_id, head, quantile_cont(w, {0}) AS e FROM att GROUP BY ALL),
mk AS (SELECT att.*, w >= e AS important FROM att JOIN ed ON att.file_id = ed.file_id AND att.head = ed.head),
un AS (SELECT file_id, frame, bool_or(important) AS important FROM mk GROUP BY ALL)"""


def attention(v: Views) -> DataFrame:
    """The first four values of a vector, without sign, as the weights of four heads."""
    return v.frames().select("file_id", "frame", F.posexplode(F.slice("vec", 1, 4)).alias("head", "w")).withColumns({"w": F.abs("w"), "head": F.col("head").cast("long")})


@query("quantile_mask", ATTENTION.format(0.5) + " SELECT file_id, head, frame, important FROM mk")
def quantile_mask(v: Views) -> DataFrame:
    return frames.importance_masks(attention(v), 0.5).select("file_id", "head", "frame", "important")


@query("mask_union", ATTENTION.format(0.9) + " SELECT file_id, frame, important FROM un")
def mask_union(v: Views) -> DataFrame:
    return frames.importance_union(attention(v), 0.9)


@query("mask_runs", ATTENTION.format(0.9) + ", ru AS (SELECT *, frame - row_number() OVER (PARTITION BY file_id ORDER BY frame) AS g FROM un WHERE important) SELECT file_id, min(frame) AS first, max(frame) + 1 AS last FROM ru GROUP BY file_id, g")
def mask_runs(v: Views) -> DataFrame:
    return frames.runs(frames.importance_union(attention(v), 0.9))


@query("combine_heads", ATTENTION.format(0.5) + " SELECT file_id, frame, max(w) AS w FROM att GROUP BY ALL")
def combine_heads(v: Views) -> DataFrame:
    return frames.combine_heads(attention(v), "max")


for _how, _sql in (("max", "max(w)"), ("union_strength", "sum(w)"), ("mean_important", "avg(w)")):

    @query(
        f"attention_envelope_{_how}",
        ATTENTION.format(0.5)
        + f", en AS (SELECT file_id, frame, coalesce({_sql} FILTER (important), 0) AS v FROM mk GROUP BY ALL) SELECT file_id, frame, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS v FROM en WINDOW w AS (PARTITION BY file_id)",
    )
    def attention_envelope(v: Views, how: str = _how) -> DataFrame:
        return rounded(frames.attention_envelope(attention(v), 0.5, how), "v")


@query(
    "attention_segments",
    ATTENTION.format(0.8)
    + """, rn AS (SELECT *, frame - row_number() OVER (PARTITION BY file_id ORDER BY frame) AS g FROM un WHERE important),
ru AS (SELECT file_id, min(frame) AS a, max(frame) + 1 AS z FROM rn GROUP BY file_id, g), lo AS (SELECT *, max((z - a > 1)::INT) OVER (PARTITION BY file_id) AS long FROM ru),
kp AS (SELECT * FROM lo WHERE long = 0 OR z - a > 1), nf AS (SELECT file_id, max(frame) + 1 AS n FROM att GROUP BY 1), sm AS (SELECT file_id, frame, sum(w) AS s FROM att GROUP BY ALL)
SELECT kp.file_id, round(a / 50.0, 6) AS start, round(arg_max(frame, (s, -frame)) / 50.0, 6) AS peak, round((z - 1) / 50.0, 6) AS "end"
FROM kp JOIN nf ON nf.file_id = kp.file_id JOIN sm ON sm.file_id = kp.file_id AND frame >= a AND frame < z GROUP BY kp.file_id, a, z, n""",
)
def attention_segments(v: Views) -> DataFrame:
    return rounded(frames.attention_segments(attention(v), 50.0, 0.8), "start", "peak", "end")


# ---- peaks and valleys -----------------------------------------------------------------------------

VALLEYS = """WITH nb AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM signal WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
va AS (SELECT file_id, t, v FROM nb WHERE v < p AND v <= q), pe AS (SELECT file_id, t, v FROM nb WHERE v > p AND v >= q)"""


def extremes(v: Views) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    w = W.partitionBy("file_id").orderBy("idx")
    rows = v.signal().select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("q"))
    return rows.filter("v < p AND v <= q").select("file_id", "t", "v"), rows.filter("v > p AND v >= q").select("file_id", "t", "v")


MERGED = (
    VALLEYS
    + """, vf AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM va WINDOW w AS (PARTITION BY file_id ORDER BY t)),
vg AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY t) AS g FROM vf), vm AS (SELECT file_id, arg_min(t, (v, t)) AS t, min(v) AS v FROM vg GROUP BY file_id, g)"""
)


@query("valley_merge", MERGED + " SELECT * FROM vm")
def valley_merge(v: Views) -> DataFrame:
    return frames.merge_valleys(extremes(v)[0], 86_400.0)


@query(
    "peak_in_interval",
    MERGED
    + """, vi AS (SELECT file_id, t AS start, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS "end" FROM vm)
SELECT vi.file_id, start, arg_max(t, (v, -t)) AS peak, "end", max(v) AS amplitude FROM vi JOIN pe ON pe.file_id = vi.file_id AND t > start AND t < "end" GROUP BY vi.file_id, start, "end" HAVING "end" - start >= 86400""",
)
def peak_in_interval(v: Views) -> DataFrame:
    valleys, peaks = extremes(v)
    return frames.peaks_between_valleys(frames.merge_valleys(valleys, 86_400.0), peaks, min_dur=86_400.0)


@query("sessions", 'SELECT file_id, segment_id, start, peak, "end", n FROM segs')
def sessions(v: Views) -> DataFrame:
    return v.segs()


# ---- clusterings -----------------------------------------------------------------------------------


def clustered(v: Views) -> DataFrame:
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


CELLS = """WITH ce AS (SELECT vec_id AS id, label, unnest(generate_series(1, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), mid AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM ce GROUP BY ALL)"""


@query(
    "calinski_harabasz",
    CELLS
    + """, al AS (SELECT dim, avg(x) AS g FROM ce GROUP BY 1), wi AS (SELECT sum((x - c) ** 2) AS w FROM ce JOIN mid ON ce.label = mid.label AND ce.dim = mid.dim), be AS (SELECT sum(n * (c - g) ** 2) AS b FROM mid JOIN al ON al.dim = mid.dim),
si AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings) SELECT round(b * (n - k) / (w * (k - 1)), 4) AS calinski_harabasz FROM si, wi, be""",
    views=False,
)
def calinski(v: Views) -> DataFrame:
    return rounded(clusterquality.calinski_harabasz(clustered(v)), "calinski_harabasz", places=4)


@query(
    "davies_bouldin",
    CELLS
    + """, d AS (SELECT ce.label, id, sqrt(sum((x - c) ** 2)) AS d FROM ce JOIN mid ON ce.label = mid.label AND ce.dim = mid.dim GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1),
fa AS (SELECT a.label, b.label AS l2, sqrt(sum((a.c - b.c) ** 2)) AS m FROM mid a JOIN mid b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL),
r AS (SELECT fa.label, max((s.s + s2.s) / m) AS r FROM fa JOIN s ON s.label = fa.label JOIN s s2 ON s2.label = l2 GROUP BY 1) SELECT round(avg(r), 4) AS davies_bouldin FROM r""",
    views=False,
)
def davies(v: Views) -> DataFrame:
    return rounded(clusterquality.davies_bouldin(clustered(v)), "davies_bouldin", places=4)


@query(
    "silhouette",
    """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
su AS (SELECT a.id, a.label, b.label AS l2, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
me AS (SELECT id, max(CASE WHEN label = l2 THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> l2 THEN d / n END) AS b FROM su GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 4) AS silhouette FROM me""",
    views=False,
)
def silhouette(v: Views) -> DataFrame:
    return rounded(clusterquality.silhouette(clustered(v)), "silhouette", places=4)


