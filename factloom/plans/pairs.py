"""Queries over pairs of facts, with brute-force SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import STOPWORDS
from factloom.operators import candidates as cand
from factloom.operators import compare as cmp
from factloom.operators import match
from factloom.operators.candidates import blocked
from factloom.plans import reports
from factloom.sources.views import FACTS, duck, read, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FACTS)


# --- SQL: every eligible pair, compared one by one -------------------------------------------------------------

_stop = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tok(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"


def _content(x: str) -> str:
    return f"list_filter({_tok(x)}, lambda t: t NOT IN ({_stop}))"


def _jac(p: str, q: str) -> str:
    both = f"len(list_intersect({p}, {q}))"
    return f"coalesce({both}::DOUBLE / nullif(len({p}) + len({q}) - {both}, 0), 0.0e0)"


def _same(p: str, q: str) -> str:
    return f"CASE WHEN trim(coalesce({p}, '')) = '' OR trim(coalesce({q}, '')) = '' THEN 'UNKNOWN' WHEN lower(trim({p})) = lower(trim({q})) THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END"


_FACTS = f"""
f0 AS ({duck(FACTS)}),
f1 AS (SELECT *, coalesce(nullif(canonical_subject, ''), nullif(subject, '')) AS ent, coalesce(nullif(canonical_predicate, ''), nullif(predicate, '')) AS claim, coalesce(normalized_unit, unit) AS eu FROM f0),
f AS (SELECT *, {_tok("subject || ' ' || predicate")} AS rt, {_content("subject || ' ' || predicate")} AS rc, {_content("ent || ' ' || claim")} AS cc, {_content("ent")} AS sc,
  concat_ws(', ', CASE WHEN normalized_number IS NULL THEN 'number' END, CASE WHEN trim(coalesce(normalized_unit, '')) = '' THEN 'unit' END, CASE WHEN time_kind = 'UNKNOWN' THEN 'period' END) AS miss,
  CASE WHEN normalized_number IS NULL THEN 'NOT_COMPARABLE' WHEN trim(coalesce(normalized_unit, '')) <> '' AND time_kind <> 'UNKNOWN' THEN 'COMPARABLE'
    WHEN trim(coalesce(normalized_unit, '')) <> '' OR time_kind <> 'UNKNOWN' THEN 'PARTIAL' ELSE 'NOT_COMPARABLE' END AS comp FROM f1)"""


def _pairs(eligible: str = "a.document_id <> b.document_id") -> str:
    time = """CASE WHEN a.time_kind = 'UNKNOWN' OR b.time_kind = 'UNKNOWN' THEN 'UNKNOWN' WHEN a.time_kind <> b.time_kind THEN 'INCOMPATIBLE'
      WHEN lower(trim(a.time_text)) = lower(trim(b.time_text)) AND trim(a.time_text) <> '' THEN 'COMPATIBLE'
      WHEN a.time_start IS NOT NULL AND a.time_end IS NOT NULL AND b.time_start IS NOT NULL AND b.time_end IS NOT NULL THEN CASE WHEN greatest(a.time_start, b.time_start) <= least(a.time_end, b.time_end) THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END
      WHEN trim(coalesce(a.time_text, '')) <> '' AND trim(coalesce(b.time_text, '')) <> '' THEN 'INCOMPATIBLE' ELSE 'UNKNOWN' END"""
    dims = {"entity": _same("a.ent", "b.ent"), "predicate": _same("a.claim", "b.claim"), "unit": _same("a.eu", "b.eu"), "time": time, "estimate_status": "CASE WHEN coalesce(a.estimate_status, 'UNKNOWN') = 'UNKNOWN' OR coalesce(b.estimate_status, 'UNKNOWN') = 'UNKNOWN' THEN 'UNKNOWN' WHEN a.estimate_status = b.estimate_status THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END", "geography": _same("a.geography", "b.geography"), "scope": _same("a.scope_text", "b.scope_text")}

    def listed(v: str, names=tuple(dims)) -> str:
        return "concat_ws(',', " + ", ".join(f"CASE WHEN d_{n} = '{v}' THEN '{n}' END" for n in names) + ")"

    diff = "CASE WHEN a.normalized_number = 0 AND b.normalized_number = 0 THEN 0.0e0 ELSE abs(a.normalized_number - b.normalized_number) / greatest(abs(a.normalized_number), abs(b.normalized_number)) END"
    return f"""WITH {_FACTS},
x AS (SELECT a, b, {", ".join(f"{c} AS d_{n}" for n, c in dims.items())}, {diff} AS diff,
  coalesce(a.canonical_subject = b.canonical_subject AND a.canonical_predicate = b.canonical_predicate AND a.value_kind = b.value_kind AND a.eu IS NOT DISTINCT FROM b.eu, false) AS strong,
  {_jac("a.cc", "b.cc")} AS sim, {_jac("a.sc", "b.sc")} AS ssim,
  ({_jac("a.rt", "b.rt")} >= 0.2e0 OR {_same("a.canonical_subject", "b.canonical_subject")} = 'COMPATIBLE' OR {_same("a.canonical_predicate", "b.canonical_predicate")} = 'COMPATIBLE') AS overlap,
  {_jac("a.rc", "b.rc")} >= 0.2e0 AS near, {_same("a.canonical_subject", "b.canonical_subject")} = 'COMPATIBLE' AND {_same("a.canonical_predicate", "b.canonical_predicate")} = 'COMPATIBLE' AS canon
  FROM f a JOIN f b ON a.fact_id < b.fact_id AND {eligible}),
y AS (SELECT *, CASE WHEN a.value_kind = 'TEXT' OR b.value_kind = 'TEXT' OR a.normalized_number IS NULL OR b.normalized_number IS NULL OR a.normalized_unit IS NULL OR b.normalized_unit IS NULL OR a.normalized_unit <> b.normalized_unit THEN 'INCOMPARABLE'
    WHEN diff = 0 THEN 'EXACT' WHEN diff <= 0.01e0 THEN 'APPROXIMATE' ELSE 'DIFFERENT' END AS v,
  NOT strong AND a.value_kind IN ('NUMERIC', 'PERCENTAGE') AND b.value_kind IN ('NUMERIC', 'PERCENTAGE') AND a.eu IS NOT DISTINCT FROM b.eu AND ssim >= 0.5e0 AND sim >= 0.6e0 AS weak,
  {listed("INCOMPATIBLE")} AS inc, {listed("UNKNOWN")} AS unk, {listed("COMPATIBLE", sorted(dims))} AS comp_dims, {listed("INCOMPATIBLE", ("unit", "time", "estimate_status", "geography", "scope"))} AS cinc,
  CASE WHEN a.comp <> 'COMPARABLE' THEN 'fact A is not comparable (missing: ' || a.miss || ')' WHEN b.comp <> 'COMPARABLE' THEN 'fact B is not comparable (missing: ' || b.miss || ')'
    WHEN d_time <> 'COMPATIBLE' THEN 'period not stated and equal on both sides' WHEN (trim(coalesce(a.scope_text, '')) = '') <> (trim(coalesce(b.scope_text, '')) = '') THEN 'scope stated on only one side' END AS reason FROM x),
z AS (SELECT *, v <> 'INCOMPARABLE' OR canon OR (d_entity = 'COMPATIBLE' AND d_predicate = 'COMPATIBLE') AS grounded FROM y),
r AS (SELECT *, CASE WHEN v IN ('EXACT', 'APPROXIMATE') AND inc = '' AND strong THEN 'R1' WHEN v IN ('EXACT', 'APPROXIMATE') AND inc = '' AND overlap THEN 'R2' WHEN v IN ('EXACT', 'APPROXIMATE') AND cinc = '' AND weak THEN 'R3'
    WHEN v = 'DIFFERENT' AND inc = '' AND strong AND reason IS NOT NULL THEN 'R4a' WHEN v = 'DIFFERENT' AND inc = '' AND strong THEN 'R4b' WHEN v = 'DIFFERENT' AND cinc = '' AND weak AND reason IS NOT NULL THEN 'R5a'
    WHEN v = 'DIFFERENT' AND cinc = '' AND weak THEN 'R5b' WHEN inc <> '' AND near AND grounded THEN 'R6' WHEN v = 'INCOMPARABLE' AND inc = '' AND strong THEN 'R7' WHEN near AND grounded THEN 'R8' ELSE 'R9' END AS rule FROM z),
t AS (SELECT *, CASE rule WHEN 'R1' THEN 'CORROBORATES' WHEN 'R3' THEN 'CORROBORATES' WHEN 'R4b' THEN 'CONTRADICTS' WHEN 'R5b' THEN 'CONTRADICTS' WHEN 'R6' THEN 'CONTEXTUAL_DIFFERENCE' WHEN 'R9' THEN 'UNRELATED' ELSE 'RELATED' END AS kind,
  CASE rule WHEN 'R1' THEN CASE WHEN v = 'EXACT' THEN 0.95e0 ELSE 0.9e0 END WHEN 'R3' THEN CASE WHEN unk <> '' THEN 0.5e0 ELSE 0.6e0 END WHEN 'R5b' THEN CASE WHEN unk <> '' THEN 0.5e0 ELSE 0.6e0 END WHEN 'R4a' THEN 0.4e0 WHEN 'R5a' THEN 0.4e0
    WHEN 'R4b' THEN CASE WHEN unk <> '' THEN 0.7e0 ELSE 0.85e0 END WHEN 'R6' THEN 0.75e0 WHEN 'R9' THEN 0.9e0 ELSE 0.5e0 END AS conf, rule IN ('R2', 'R3', 'R4a', 'R5a', 'R5b', 'R7') AS ask FROM r)
"""


_ID = "a.fact_id AS a_fact_id, b.fact_id AS b_fact_id"
_PAIRS = _pairs()
_REL = _PAIRS.rstrip() + """,
rel AS (SELECT a.fact_id AS fact_a_id, b.fact_id AS fact_b_id, a.fact_id || '~' || b.fact_id AS relationship_id, kind AS relationship_type, rule AS rule_id, CASE WHEN ask THEN least(conf, 0.5e0) ELSE conf END AS confidence,
  CASE WHEN ask THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END AS status, rule IN ('R3', 'R5a', 'R5b') AS weak_tier, rule IN ('R4a', 'R5a') AS withheld FROM t WHERE rule <> 'R9')
"""
REL_COLUMNS = ["fact_a_id", "fact_b_id", "relationship_id", "relationship_type", "rule_id", "confidence", "status"]


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmp.compared(blocked(facts(spark, sf_dir)))


_BLOCKED = " WHERE list_has_any(a.rc, b.rc) OR list_has_any(a.cc, b.cc) OR list_has_any(a.rc, b.cc) OR list_has_any(a.cc, b.rc) OR lower(trim(a.ent)) = lower(trim(b.ent))"


@query(_PAIRS + f"SELECT {_ID}, v AS numeric_verdict, CASE WHEN v <> 'INCOMPARABLE' THEN round(diff, 9) END AS difference FROM t" + _BLOCKED)
def numeric_verdict(spark, sf_dir):
    d = F.when(F.col("numeric_verdict") != "INCOMPARABLE", F.round(cmp.relative_difference(*cmp.both("normalized_number")), 9))
    return _shared(spark, sf_dir).select("a_fact_id", "b_fact_id", "numeric_verdict", d.alias("difference"))


@query(_PAIRS + f"SELECT {_ID}, {', '.join(f'd_{n}' for n in cmp.DIMENSIONS)} FROM t" + _BLOCKED)
def context_dims(spark, sf_dir):
    return _shared(spark, sf_dir).select("a_fact_id", "b_fact_id", *(f"d_{n}" for n in cmp.DIMENSIONS))


@query(_PAIRS + f"SELECT {_ID}, strong AS strong_match, weak AS weak_match, round(sim, 9) AS claim_similarity FROM t" + _BLOCKED)
def match_tiers(spark, sf_dir):
    return _shared(spark, sf_dir).select("a_fact_id", "b_fact_id", "strong_match", "weak_match", F.round("claim_similarity", 9).alias("claim_similarity"))


@query(_PAIRS + f"SELECT {_ID}, overlap AS semantic_overlap, near AS claims_comparable, grounded FROM t" + _BLOCKED)
def overlap_flags(spark, sf_dir):
    return _shared(spark, sf_dir).select("a_fact_id", "b_fact_id", "semantic_overlap", "claims_comparable", "grounded")


@query(_PAIRS + f"SELECT {_ID}, reason AS blocked_reason FROM t" + _BLOCKED)
def gate_reasons(spark, sf_dir):
    return _shared(spark, sf_dir).select("a_fact_id", "b_fact_id", "blocked_reason")


@query(_PAIRS + f"SELECT {_ID}, rule AS rule_id, kind AS relationship_type, conf AS confidence, ask AS needs_llm FROM t WHERE rule <> 'R9'")
def classify_pairs(spark, sf_dir):
    return cmp.classified(blocked(facts(spark, sf_dir))).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "rule_id", "relationship_type", "confidence", "needs_llm")


@query(_PAIRS + f"""SELECT {_ID}, v AS numeric_verdict, inc AS incompatible, unk AS unknown, comp_dims AS compatible, strong AS strong_match, overlap AS semantic_overlap, CASE WHEN v <> 'INCOMPARABLE' THEN round(diff, 9) END AS difference,
CASE WHEN rule IN ('R3', 'R5a', 'R5b') THEN round_even(sim, 4) END AS claim_similarity, CASE WHEN rule IN ('R3', 'R5a', 'R5b') THEN 'weak' END AS match_tier, CASE WHEN rule IN ('R4a', 'R5a') THEN 'CONTRADICTS' END AS withheld_verdict, CASE WHEN rule IN ('R4a', 'R5a') THEN reason END AS withheld_reason FROM t WHERE rule <> 'R9'""")
def reasoning_metadata(spark, sf_dir):
    m = cmp.classified(blocked(facts(spark, sf_dir))).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", cmp.metadata().alias("m"))
    lists = {"incompatible": "incompatible_dimensions", "unknown": "unknown_dimensions", "compatible": "compatible_dimensions"}
    return m.select("a_fact_id", "b_fact_id", "m.numeric_verdict", *(F.array_join(f"m.{c}", ",").alias(n) for n, c in lists.items()), "m.strong_match", "m.semantic_overlap", F.round("m.relative_difference", 9).alias("difference"), "m.claim_similarity", "m.match_tier", "m.withheld_verdict", "m.withheld_reason")


def _explained() -> str:
    def listed(c: str) -> str:
        return f"CASE WHEN {c} = '' THEN 'none' ELSE replace({c}, ',', ', ') END"

    def shown(x: str) -> str:
        return f"CASE WHEN trim(coalesce({x}, '')) = '' THEN 'missing' ELSE chr(39) || {x} || chr(39) END"

    sides = {"entity": "ent", "predicate": "claim", "unit": "eu", "time": "time_text", "estimate_status": "estimate_status", "geography": "geography", "scope": "scope_text"}
    differs = "concat_ws(', ', " + ", ".join(f"CASE WHEN d_{d} = 'INCOMPATIBLE' THEN '{d} (' || {shown('a.' + c)} || ' vs ' || {shown('b.' + c)} || ')' END" for d, c in sides.items()) + ")"
    numbers = "CASE WHEN v = 'INCOMPARABLE' THEN 'no shared normalized number and unit' ELSE format('normalized {:.4f} vs {:.4f} {}, {}, relative difference {:.4f}', a.normalized_number, b.normalized_number, a.normalized_unit, v, diff) END"
    dims = f"'; compatible: ' || {listed('comp_dims')} || '; incompatible: ' || {listed('inc')} || '; unknown: ' || {listed('unk')}"
    aligned = "CASE WHEN strong THEN '; entity, claim and unit are aligned' ELSE '; entity and unit are aligned, claims are alike' END"
    not_ = "'aren' || chr(39) || 't"
    told = f"""CASE kind WHEN 'CORROBORATES' THEN 'agree (' || {numbers} || ')' || {dims} || {aligned} || ' and no context stands against it'
WHEN 'CONTRADICTS' THEN 'differ materially (' || {numbers} || ') in a context that nothing sets apart' || {dims} || {aligned} || CASE WHEN unk <> '' THEN '; confidence is held down by what is unknown' ELSE '' END
WHEN 'CONTEXTUAL_DIFFERENCE' THEN {not_} to be equated (' || {numbers} || '); their context differs on ' || {differs} || '; they mean the same (strong match: ' || CASE WHEN strong THEN 'yes' ELSE 'no' END || ', words in common: ' || CASE WHEN overlap THEN 'yes' ELSE 'no' END || '), so the gap is put down to context'
WHEN 'RELATED' THEN 'share part of their meaning, but neither agree nor contradict (' || {numbers} || ')' || {dims} || CASE WHEN ask THEN '; to be reviewed' ELSE '' END
ELSE {not_} aligned (' || {numbers} || ')' || {dims} || '; no entity or claim in common' END"""
    return f"kind || ': value ' || chr(39) || a.value_text || chr(39) || ' and value ' || chr(39) || b.value_text || chr(39) || ' ' || {told}"


@query(_PAIRS + f"SELECT {_ID}, kind AS relationship_type, {_explained()} AS explanation FROM t WHERE rule <> 'R9'")
def explanation_text(spark, sf_dir):
    return cmp.classified(blocked(facts(spark, sf_dir))).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "relationship_type", cmp.explanation().alias("explanation"))


@query(_PAIRS + "SELECT kind AS relationship_type, rule AS rule_id, count(*) AS n FROM t GROUP BY kind, rule")
def verdict_histogram(spark, sf_dir):
    """Unrelated pairs are never made: they are what the closed form counts beyond the others."""
    f = facts(spark, sf_dir)
    typed = reports.verdict_histogram(cmp.classified(blocked(f)).where("rule_id <> 'R9'"))
    rest = cand.space(f).join(typed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("typed")), F.lit(True)).select(F.lit("UNRELATED").alias("relationship_type"), F.lit("R9").alias("rule_id"), (F.col("pairs") - F.col("typed")).alias("n")).where("n > 0")
    return typed.unionByName(rest)


@query(_PAIRS + f"SELECT {_ID}, rule AS rule_id FROM t WHERE rule <> 'R9'")
def candidates_exhaustive(spark, sf_dir):
    return cmp.classified(blocked(facts(spark, sf_dir))).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "rule_id")


@query(_pairs("true") + f"SELECT {_ID}, rule AS rule_id FROM t WHERE rule <> 'R9'")
def candidates_same_doc(spark, sf_dir):
    return cmp.classified(blocked(facts(spark, sf_dir), include_same_document=True)).where("rule_id <> 'R9'").select("a_fact_id", "b_fact_id", "rule_id")


@query(f"WITH {_FACTS} SELECT count(*) FILTER (a.document_id <> b.document_id) AS pairs, count(*) AS with_same_document FROM f a JOIN f b ON a.fact_id < b.fact_id")
def candidate_space(spark, sf_dir):
    f = facts(spark, sf_dir)
    return cand.space(f).join(cand.space(f, True).withColumnRenamed("pairs", "with_same_document"), F.lit(True))


def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.label <> c.label WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s WHERE score >= 0.25e0) SELECT query_id, candidate_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def candidates_vector(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return cand.by_vector(v, v.where("id % 50 = 0")).select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_WORDS = f"""WITH {_FACTS}, w AS (SELECT fact_id, document_id, {_tok("ent || ' ' || claim")} AS t FROM f),
s AS (SELECT q.fact_id AS query_id, c.fact_id AS candidate_id, {_jac("q.t", "c.t")} AS score FROM w q JOIN w c ON q.document_id <> c.document_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s WHERE score >= 0.25e0)
"""


@query(_WORDS + "SELECT query_id, candidate_id, rank, round(score, 9) AS score FROM r WHERE rank <= 10")
def candidates_lexical(spark, sf_dir):
    return cand.by_words(facts(spark, sf_dir)).select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


_MIXED_VECTORS = "SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS i FROM f"


@query(f"""WITH {_FACTS}, n AS ({_MIXED_VECTORS}), v AS (SELECT f.fact_id, document_id, embedding::DOUBLE[] AS e FROM f JOIN n USING (fact_id) JOIN embeddings ON vec_id = i WHERE i % 3 <> 0),
w AS (SELECT fact_id, document_id, {_tok("ent || ' ' || claim")} AS t FROM f),
vs AS (SELECT q.fact_id AS query_id, c.fact_id AS candidate_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.document_id <> c.document_id),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM vs WHERE score >= 0.25e0) u WHERE rank <= 10),
vn AS (SELECT query_id, count(*) AS n FROM vr GROUP BY query_id),
ws AS (SELECT q.fact_id AS query_id, c.fact_id AS candidate_id, {_jac("q.t", "c.t")} AS score FROM w q JOIN w c ON q.document_id <> c.document_id WHERE q.fact_id NOT IN (SELECT fact_id FROM v) OR c.fact_id NOT IN (SELECT fact_id FROM v)),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM ws WHERE score >= 0.25e0),
m AS (SELECT query_id, candidate_id, score FROM vr UNION ALL SELECT wr.query_id, candidate_id, score FROM wr LEFT JOIN vn USING (query_id) WHERE rank <= 10 - coalesce(n, 0))
SELECT least(query_id, candidate_id) AS fact_a_id, greatest(query_id, candidate_id) AS fact_b_id, round(max(score), 6) AS score FROM m GROUP BY 1, 2""")
def candidates_mixed(spark, sf_dir):
    """Every third fact has no vector: those queries rank by words, the others fill up with such candidates."""
    f = facts(spark, sf_dir)
    ids = f.select("fact_id", (F.row_number().over(Window.orderBy("fact_id")) - 1).alias("i"))  # the facts of two reports: nations by years
    with_vector = f.join(ids, "fact_id").join(_vectors(spark, sf_dir).select(F.col("id").alias("i"), "v"), "i").where("i % 3 <> 0").select(F.col("fact_id").alias("id"), "document_id", "v")
    ranked = cand.by_vector(with_vector, with_vector)
    lacking = f.join(with_vector.select(F.col("id").alias("fact_id")), "fact_id", "left_anti")
    having = f.join(with_vector.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    worded = cand.by_words(lacking, having).unionByName(cand.by_words(f, lacking))
    return cand.unordered(cand.mixed(ranked, worded)).select(F.col("a").alias("fact_a_id"), F.col("b").alias("fact_b_id"), F.round("score", 6).alias("score"))


def relationships(spark, sf_dir) -> DataFrame:
    return match.verdicts(facts(spark, sf_dir))


#: Two reports, the second split in two, so that there are three documents.
_DOC = "CASE WHEN {0}.document_id = 'report-B' AND {0}.h % 2 = 0 THEN 'report-C' ELSE {0}.document_id END"


def three_documents(spark, sf_dir) -> DataFrame:
    return facts(spark, sf_dir).withColumn("document_id", F.expr(_DOC.replace("{0}.", "")))


def _of_document(document: str, others: tuple[str, ...] | None = None, same: bool = False) -> str:
    a, b = _DOC.format("a"), _DOC.format("b")
    touch = f"(({a}) = '{document}' OR ({b}) = '{document}')"
    inside = "" if others is None else " AND " + " AND ".join(f"({x}) IN ({', '.join(repr(o) for o in (document, *others))})" for x in (a, b))
    return touch + inside + ("" if same else f" AND ({a}) <> ({b})")


def _matched(f: DataFrame, document: str, same: bool = False, **more) -> DataFrame:
    pairs, _ = cand.chosen(f, document, include_same_document=same, **more)
    return match.verdicts(f, pairs=pairs).select("fact_a_id", "fact_b_id", "relationship_type", "rule_id", "confidence", "status")


_RUN = "SELECT a.fact_id AS fact_a_id, b.fact_id AS fact_b_id, kind AS relationship_type, rule AS rule_id, CASE WHEN ask THEN least(conf, 0.5e0) ELSE conf END AS confidence, CASE WHEN ask THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END AS status FROM t WHERE rule <> 'R9'"


@query(_pairs(_of_document("report-C", same=True)) + _RUN)
def match_document(spark, sf_dir):
    """One document against all, and within itself."""
    return _matched(three_documents(spark, sf_dir), "report-C", same=True)


@query(_pairs(_of_document("report-C", ("report-B",))) + _RUN)
def compare_with(spark, sf_dir):
    """One document against one other: its own facts always take part."""
    return _matched(match.scoped(three_documents(spark, sf_dir), "report-C", ["report-B"]), "report-C")


@query(_pairs(_of_document("report-C")).rstrip() + f""", w AS (SELECT fact_id, {_DOC.format("f")} AS document_id, {_tok("ent || ' ' || claim")} AS words FROM f),
s AS (SELECT q.fact_id AS query_id, c.fact_id AS candidate_id, {_jac("q.words", "c.words")} AS score FROM w q JOIN w c ON q.document_id = 'report-C' AND c.document_id <> 'report-C'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s WHERE score >= 0.25e0) r WHERE rank <= 3)
SELECT 'exhaustive' AS mode, a.fact_id AS fact_a_id, b.fact_id AS fact_b_id, rule AS rule_id FROM t WHERE rule <> 'R9'
UNION ALL SELECT 'ranked', a.fact_id, b.fact_id, rule FROM t WHERE rule <> 'R9' AND EXISTS (SELECT 1 FROM best WHERE (query_id = a.fact_id AND candidate_id = b.fact_id) OR (query_id = b.fact_id AND candidate_id = a.fact_id))""")
def mode_choice(spark, sf_dir):
    """All pairs while the space is small enough; else the best candidates of each fact."""
    f, out = three_documents(spark, sf_dir), None
    for up_to in (cand.EXHAUSTIVE_UP_TO * 1000, 0):
        pairs, mode = cand.chosen(f, "report-C", up_to=up_to, k=3)
        part = cmp.classified(pairs).where("rule_id <> 'R9'").select(F.lit(mode).alias("mode"), F.col("a_fact_id").alias("fact_a_id"), F.col("b_fact_id").alias("fact_b_id"), "rule_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(_REL + """SELECT relationship_id, CASE WHEN status = 'NEEDS_REVIEW' THEN CASE WHEN CAST(substr(fact_a_id, 6, 4) AS INT) % 2 = 0 THEN 'TimeoutError: busy' ELSE 'JudgmentError: not an object with the expected keys' END END AS needs_review_reason, status, confidence FROM rel""")
def judge_failures(spark, sf_dir):
    """A judge that fails for even years and answers no JSON for others: all pairs keep waiting, with the reason."""
    rels = relationships(spark, sf_dir)
    even = F.substring("fact_a_id", 6, 4).cast("int") % 2 == 0
    asked = rels.where("status = 'NEEDS_REVIEW'").select("fact_a_id", "fact_b_id", F.when(~even, "no json").alias("raw"), F.when(even, "TimeoutError: busy").alias("error"))
    return match.judged(rels, asked).select("relationship_id", "needs_review_reason", "status", "confidence")


@query(_REL + """SELECT relationship_id, 'ev-' || fact_a_id || ': line of ' || fact_a_id AS a_evidence, CASE WHEN CAST(substr(fact_b_id, 6, 4) AS INT) % 2 = 0 THEN '' ELSE 'ev-' || fact_b_id || ': line of ' || fact_b_id END AS b_evidence FROM rel WHERE relationship_type = 'CONTRADICTS'""")
def relationship_evidence(spark, sf_dir):
    """Both facts of a relationship with their evidence; some facts name evidence that isn't stored."""
    f = facts(spark, sf_dir).withColumn("evidence_ids", F.array(F.lit("ev-nowhere"), F.concat(F.lit("ev-"), "fact_id")))
    units = f.where("not (document_id = 'report-B' and cast(substr(fact_id, 6, 4) as int) % 2 = 0)").select(F.concat(F.lit("ev-"), "fact_id").alias("evidence_id"), F.lit(0).alias("page"), F.lit("TEXT").alias("type"), F.concat(F.lit("line of "), "fact_id").alias("text"))
    told = match.detailed(relationships(spark, sf_dir).where("relationship_type = 'CONTRADICTS'"), f, units)
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["evidence_id"], F.lit(": "), e["text"])), ", ")
    return told.select("relationship_id", shown("a_evidence").alias("a_evidence"), shown("b_evidence").alias("b_evidence"))


#: Pairs that count as stored before: those of nations with an even key on side A.
_OLD = "CAST(substr(fact_a_id, 3, 2) AS INT) % 2 = 0"


def _stored(rels: DataFrame) -> DataFrame:
    return rels.where(_OLD).withColumns({"relationship_id": F.concat(F.lit("old:"), "relationship_id"), "confidence": F.lit(0.1)})


@query(_REL + f"SELECT fact_a_id, fact_b_id, CASE WHEN {_OLD} THEN 'old:' || relationship_id ELSE relationship_id END AS relationship_id, relationship_type, rule_id, CASE WHEN {_OLD} THEN 0.1e0 ELSE confidence END AS confidence, status FROM rel")
def match_persist(spark, sf_dir):
    """A run over a store that holds part of the pairs adds the others and leaves those alone."""
    rels = relationships(spark, sf_dir).select(REL_COLUMNS)
    return match.merged(_stored(rels), rels)


@query(_REL + f"SELECT fact_a_id, fact_b_id, CASE WHEN {_OLD} THEN 'old:' || relationship_id ELSE relationship_id END AS relationship_id, relationship_type, rule_id, confidence, status FROM rel WHERE rule_id <> 'R8' UNION ALL SELECT fact_a_id, fact_b_id, 'old:' || relationship_id, relationship_type, rule_id, 0.1e0, status FROM rel WHERE rule_id = 'R8' AND {_OLD}")
def match_recompute(spark, sf_dir):
    """With recompute, stored pairs keep their id and take the new verdict; those that come out unrelated (here: R8) stay as stored."""
    rels = relationships(spark, sf_dir).select(REL_COLUMNS)
    return match.merged(_stored(rels), rels.where("rule_id <> 'R8'"), recompute=True)


#: Judgments for pairs that wait, by the year of side A: withheld type, another type, not JSON, a wrong type, a wrong confidence.
_JUDGED = """CASE CAST(substr(fact_a_id, 6, 4) AS INT) % 5 WHEN 0 THEN '{"relationship_type": "CONTRADICTS", "confidence": 0.8, "explanation": "they differ"}' WHEN 1 THEN '{"relationship_type": "CORROBORATES", "confidence": 0.7, "explanation": "they agree"}'
WHEN 2 THEN 'not json' WHEN 3 THEN '{"relationship_type": "UNRELATED", "confidence": 0.7, "explanation": "x"}' ELSE '{"relationship_type": "RELATED", "confidence": 1.7, "explanation": "x"}' END"""


@query(_REL + f""", j AS (SELECT *, CAST(substr(fact_a_id, 6, 4) AS INT) % 5 AS k FROM rel)
SELECT fact_a_id, fact_b_id, rule_id, CASE WHEN status = 'NEEDS_REVIEW' AND k = 0 AND NOT withheld THEN 'CONTRADICTS' WHEN status = 'NEEDS_REVIEW' AND k = 1 THEN 'CORROBORATES' ELSE relationship_type END AS relationship_type,
CASE WHEN status = 'NEEDS_REVIEW' AND k IN (0, 1) THEN CASE WHEN weak_tier THEN least(confidence, CASE WHEN k = 0 THEN 0.8e0 ELSE 0.7e0 END) ELSE CASE WHEN k = 0 THEN 0.8e0 ELSE 0.7e0 END END ELSE confidence END AS confidence,
CASE WHEN status = 'NEEDS_REVIEW' AND k IN (0, 1) THEN 'RESOLVED' ELSE status END AS status, CASE WHEN status = 'NEEDS_REVIEW' AND k = 0 AND withheld THEN 'CONTRADICTS' END AS llm_overruled,
CASE WHEN status = 'NEEDS_REVIEW' THEN CASE k WHEN 2 THEN 'JudgmentError: not an object with the expected keys' WHEN 3 THEN 'JudgmentError: relationship_type not allowed' WHEN 4 THEN 'JudgmentError: confidence not in 0..1' END END AS needs_review_reason FROM j""")
def judgment_merge(spark, sf_dir):
    rels = relationships(spark, sf_dir)
    judgments = rels.where("status = 'NEEDS_REVIEW'").select("fact_a_id", "fact_b_id", F.expr(_JUDGED).alias("raw"))
    return match.judged(rels, judgments).select("fact_a_id", "fact_b_id", "rule_id", "relationship_type", "confidence", "status", "llm_overruled", "needs_review_reason")


@query(_REL + "SELECT fact_a_id, fact_b_id, relationship_type, confidence FROM rel WHERE confidence >= 0.5e0 AND relationship_type = 'CORROBORATES' AND (fact_a_id IN (SELECT fact_id FROM f WHERE document_id = 'report-B') OR fact_b_id IN (SELECT fact_id FROM f WHERE document_id = 'report-B'))")
def relationships_for_doc(spark, sf_dir):
    return match.touching(relationships(spark, sf_dir), facts(spark, sf_dir), "report-B", "CORROBORATES", 0.5).select("fact_a_id", "fact_b_id", "relationship_type", "confidence")


@query(_REL + "SELECT relationship_id, relationship_type, a.subject AS a_subject, a.value_text AS a_value, b.subject AS b_subject, b.value_text AS b_value, a.time_text AS a_time, b.time_text AS b_time FROM rel JOIN f a ON a.fact_id = fact_a_id JOIN f b ON b.fact_id = fact_b_id WHERE relationship_type = 'CONTRADICTS'")
def relationship_detail(spark, sf_dir):
    f = facts(spark, sf_dir)
    return relationships(spark, sf_dir).where("relationship_type = 'CONTRADICTS'").join(cmp.side(f, "a"), F.col("a_fact_id") == F.col("fact_a_id")).join(cmp.side(f, "b"), F.col("b_fact_id") == F.col("fact_b_id")).select("relationship_id", "relationship_type", "a_subject", F.col("a_value_text").alias("a_value"), "b_subject", F.col("b_value_text").alias("b_value"), F.col("a_time_text").alias("a_time"), F.col("b_time_text").alias("b_time"))


@query(_REL + "SELECT relationship_id, relationship_type, confidence, CASE relationship_type WHEN 'CONTRADICTS' THEN 0 WHEN 'CORROBORATES' THEN 1 WHEN 'RELATED' THEN 2 ELSE 3 END AS review_rank FROM rel ORDER BY review_rank, confidence DESC, relationship_id LIMIT 300")
def review_order(spark, sf_dir):
    return match.review_order(relationships(spark, sf_dir)).select("relationship_id", "relationship_type", "confidence", "review_rank")


@query(_REL + """, e AS (SELECT fact_a_id, fact_b_id, fact_a_id AS fact_id FROM rel UNION ALL SELECT fact_a_id, fact_b_id, fact_b_id FROM rel), n AS (SELECT document_id, count(DISTINCT (fact_a_id, fact_b_id)) AS r FROM e JOIN f USING (fact_id) GROUP BY document_id),
d AS (SELECT document_id, count(*) AS facts, count(*) FILTER (comp = 'COMPARABLE') AS comparable FROM f GROUP BY document_id), b AS (SELECT document_id, facts, comparable, coalesce(r, 0) AS relationships FROM d LEFT JOIN n USING (document_id))
SELECT document_id, sum(facts)::BIGINT AS facts, sum(comparable)::BIGINT AS comparable, sum(relationships)::BIGINT AS relationships FROM b GROUP BY ROLLUP (document_id)""")
def workspace_rollup(spark, sf_dir):
    return reports.workspace(facts(spark, sf_dir), relationships(spark, sf_dir))


@query(_REL + f", s AS (SELECT count(*) AS skipped FROM rel WHERE {_OLD}), n AS (SELECT count(*) AS pairs FROM t) SELECT pairs - skipped AS evaluated, skipped, (SELECT count(*) FROM rel WHERE NOT ({_OLD})) AS typed, pairs - (SELECT count(*) FROM rel) AS unrelated FROM n, s")
def matching_report(spark, sf_dir):
    f = facts(spark, sf_dir)
    rels = relationships(spark, sf_dir).select(REL_COLUMNS)
    stored = _stored(rels)
    return reports.matching_report(cand.space(f), stored, match.new_only(rels, stored))
