"""Question-answering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as PT
from ..functions import text as TX
from ..operators import advice as AD
from ..operators import cohorts as CH
from ..operators import explain as EX
from ..operators import retrieval as RT
from ..operators import scoring as SC
from .common import round_doubles, views
from . import q_explain as QE
from .q_explain import _attr_sql, explained
from .registry import register


def _texts(v):
    """Questions plus user turns of conversations, as (source, item_id, turn, text)."""
    q = v.questions.select(F.lit("question").alias("source"), F.col("question_id").alias("item_id"),
                           F.lit(0).cast("bigint").alias("turn"), F.col("question").alias("text"))
    c = v.t.conversations.where(F.col("role") == "user").select(
        F.lit("conversation").alias("source"), F.col("conv_id").alias("item_id"), F.col("turn"), "text")
    return q.unionByName(c)


_KW_SQL = " OR ".join(f"contains(lower(text), '{k}')" for k in TX.BANK_KEYWORDS)
_TEXTS_SQL = """texts AS (
  SELECT 'question' AS source, question_id AS item_id, CAST(0 AS BIGINT) AS turn, question AS text FROM questions
  UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations WHERE role = 'user')"""
_AMOUNT_SQL = ("list_filter(list_transform(regexp_extract_all(replace({t}, ',', ''), '[0-9]+'), "
               "lambda x: CAST(x AS DOUBLE)), lambda x: x >= 50000)[1]")


def _intent_sql(t: str) -> str:
    q = f"lower({t})"
    c = lambda *ws: "(" + " OR ".join(f"contains({q}, '{w}')" for w in ws) + ")"
    return (f"CASE WHEN {c('bank balance', 'average balance')} THEN 'bank_balance' "
            f"WHEN {c('income', 'salary')} THEN 'income' "
            f"WHEN contains({q}, 'emi') AND {c('ratio', 'income')} THEN 'emi_ratio' "
            f"WHEN {c('credit history', 'cibil', 'score')} THEN 'credit' "
            f"WHEN {c('mobile', 'digital', 'behaviour', 'behavior')} THEN 'behaviour' "
            f"WHEN {c('utilisation', 'utilization', 'usage')} THEN 'utilisation' ELSE 'retrieval' END")


@register("topic_gate", oracle=f"WITH {_TEXTS_SQL} SELECT source, item_id, turn, COALESCE({_KW_SQL}, FALSE) AS is_banking FROM texts",
          views=("questions",))
def topic_gate(spark, sf_dir):
    t = _texts(views(spark, sf_dir))
    return t.select("source", "item_id", "turn", TX.is_banking(F.col("text")).alias("is_banking"))


@register("extract_amount", oracle=f"WITH {_TEXTS_SQL} SELECT source, item_id, turn, {_AMOUNT_SQL.format(t='text')} AS amount FROM texts",
          views=("questions",))
def extract_amount(spark, sf_dir):
    t = _texts(views(spark, sf_dir))
    return t.select("source", "item_id", "turn", TX.loan_amount(F.col("text")).alias("amount"))


#: Digits of four scripts in which questions are asked.
_SCRIPTS = ["०१२३४५६७८९", "٠١٢٣٤٥٦٧٨٩", "௦௧௨௩௪௫௬௭௮௯", "０１２３４５６７８９"]
_IN_SCRIPT_SQL = "CASE question_id % 4 " + " ".join(f"WHEN {i} THEN translate(question, '0123456789', '{d}')" for i, d in enumerate(_SCRIPTS)) + " END"


@register("rule_routes", oracle=f"""
WITH {_TEXTS_SQL} SELECT source, item_id, turn, COALESCE({_KW_SQL}, FALSE) AS is_banking, {_intent_sql('text')} AS intent FROM texts""", views=("questions",))
def rule_routes(spark, sf_dir):
    """X1 + X3 through rule tables: one pass over a text for all words of the gate and the intents."""
    gate, intents = TX.question_rules()
    t = _texts(views(spark, sf_dir)).withColumn("low", F.lower("text"))
    return t.select("source", "item_id", "turn", (PT.matched(F.col("low"), gate)["n"] > 0).alias("is_banking"),
                    F.coalesce(PT.matched(F.col("low"), intents)["first"], F.lit("retrieval")).alias("intent"))


@register("vocabulary_rules", oracle="""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}')) AS word FROM benchmark),
t AS (SELECT row_number() OVER () AS r, conv_id, turn, role, lower(text) AS text FROM conversations)
SELECT conv_id, turn, role, min(word) AS first_rule, CAST(count(word) AS INT) AS n_rules FROM t LEFT JOIN w ON contains(t.text, w.word) GROUP BY r, conv_id, turn, role""")
def vocabulary_rules(spark, sf_dir):
    """J7 with a large rule table: every word of the benchmark is a rule, and each turn is told which come up in it and which is first."""
    t = views(spark, sf_dir).t
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]{4,})"), 1)).alias("w")).distinct().orderBy("w").limit(PT.MAX_RULES + 1)
    table = PT.RuleTable([PT.Rule.any_of(r["w"], [r["w"]]) for r in words.collect()])
    return t.conversations.select("conv_id", "turn", "role", PT.matched(F.lower("text"), table).alias("m")).select(
        "conv_id", "turn", "role", F.col("m.first").alias("first_rule"), F.col("m.n").alias("n_rules"))


@register("extract_amount_scripts", oracle=f"""
SELECT question_id, {_IN_SCRIPT_SQL} AS question, {_AMOUNT_SQL.format(t='question')} AS amount FROM questions""", views=("questions",))
def extract_amount_scripts(spark, sf_dir):
    """X2 over questions whose numbers are written in Devanagari, Arabic-Indic, Tamil or full-width digits; SQL reads the ASCII form."""
    q = views(spark, sf_dir).questions
    told = q.select("question_id", F.expr(_IN_SCRIPT_SQL).alias("question"))
    return told.select("question_id", "question", TX.loan_amount(F.col("question")).alias("amount"))


@register("intent_route", oracle=f"""
WITH {_TEXTS_SQL}
SELECT source, item_id, turn, COALESCE({_KW_SQL}, FALSE) AS is_banking,
       CASE WHEN NOT COALESCE({_KW_SQL}, FALSE) THEN 'refused' ELSE {_intent_sql('text')} END AS intent
FROM texts""", views=("questions",))
def intent_route(spark, sf_dir):
    t = _texts(views(spark, sf_dir))
    gate = TX.is_banking(F.col("text"))
    return t.select("source", "item_id", "turn", gate.alias("is_banking"),
                    F.when(~gate, F.lit("refused")).otherwise(TX.intent(F.col("text"))).alias("intent"))


def _base(v):
    return CH.cohort_base(v.scored)


def _amounts(v):
    return _texts(v).select(TX.loan_amount(F.col("text")).alias("amount"))


def _cohorts(v, which=None):
    return CH.cohort_stats(_amounts(v), _base(v), which)


_BASE_SQL = """
base AS (SELECT * REPLACE (
           CASE WHEN isinf(income_to_emi_ratio) OR isnan(income_to_emi_ratio) THEN NULL ELSE income_to_emi_ratio END AS income_to_emi_ratio,
           CASE WHEN isinf(credit_utilization) OR isnan(credit_utilization) THEN NULL ELSE credit_utilization END AS credit_utilization,
           CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(bank_balance AS DOUBLE) AS bank_balance)
         FROM risk_full WHERE Approved = 1 AND LoanAmount IS NOT NULL AND bank_balance IS NOT NULL)"""

_COHORT_SQL = _BASE_SQL + f""",
{_TEXTS_SQL},
amounts AS (SELECT DISTINCT {_AMOUNT_SQL.format(t='text')} AS amount FROM texts),
am AS (SELECT amount FROM amounts WHERE amount IS NOT NULL),
inr AS (SELECT a.amount, b.* FROM am a JOIN base b ON b.LoanAmount >= a.amount * 0.7e0 AND b.LoanAmount <= a.amount * 1.3e0),
cnt AS (SELECT a.amount, COUNT(inr.application_id) AS n FROM am a LEFT JOIN inr ON a.amount = inr.amount GROUP BY 1),
coh AS (SELECT amount, FALSE AS uses_fallback, * EXCLUDE (amount) FROM inr
        UNION ALL SELECT c.amount, TRUE, b.* FROM cnt c CROSS JOIN base b WHERE c.n = 0
        UNION ALL SELECT CAST(NULL AS DOUBLE), FALSE, b.* FROM base b),
st AS (SELECT amount, bool_or(uses_fallback) AS uses_fallback, CAST(COUNT(*) AS BIGINT) AS cohort_rows,
  COUNT(*) FILTER (WHERE Credit_History = 1) * 1.0e0 / GREATEST(COUNT(*), 1) AS good_share,
  {", ".join(f"quantile_cont({c}, {p}) AS {pre}_q{int(p * 100)}" for pre, c in CH.STATS for p in CH.PROBS)}
  FROM coh GROUP BY amount)"""


def _q_sql(pre: str) -> str:
    return ", ".join(f"ROUND({pre}_q{int(p * 100)}, 6) AS {pre}_q{int(p * 100)}" for p in CH.PROBS)


def _q_cols(pre: str):
    return [f"{pre}_q{int(p * 100)}" for p in CH.PROBS]


@register("cohort_base", oracle=_BASE_SQL.replace("base AS", "WITH base AS", 1) + """
SELECT application_id, LoanAmount, bank_balance, total_income, ROUND(income_to_emi_ratio, 6) AS income_to_emi_ratio,
       ROUND(credit_utilization, 6) AS credit_utilization FROM base""", views=("risk_full",))
def cohort_base(spark, sf_dir):
    b = _base(views(spark, sf_dir))
    return round_doubles(b.select("application_id", "LoanAmount", "bank_balance", "total_income",
                                  "income_to_emi_ratio", "credit_utilization"))


@register("cohort_range", oracle="WITH " + _COHORT_SQL.lstrip() + """
SELECT amount, uses_fallback, cohort_rows FROM st""", views=("risk_full", "questions"))
def cohort_range(spark, sf_dir):
    return _cohorts(views(spark, sf_dir), []).select("amount", "uses_fallback", "cohort_rows")


def _cohort_query(name: str, cols_sql: str, cols, which):
    @register(name, oracle="WITH " + _COHORT_SQL.lstrip() + f"\nSELECT amount, cohort_rows, {cols_sql} FROM st",
              views=("risk_full", "questions"))
    def q(spark, sf_dir):
        return round_doubles(_cohorts(views(spark, sf_dir), which).select("amount", "cohort_rows", *cols))
    return q


_cohort_query("cohort_bank_balance", _q_sql("bal"), _q_cols("bal"), ["bal"])
_cohort_query("cohort_income", _q_sql("inc"), _q_cols("inc"), ["inc"])
_cohort_query("cohort_emi_ratio", _q_sql("ratio"), _q_cols("ratio"), ["ratio"])
_cohort_query("cohort_credit", "ROUND(good_share, 6) AS good_share, " + _q_sql("cibil"), ["good_share"] + _q_cols("cibil"),
              ["cibil"])
_cohort_query("cohort_utilization", _q_sql("util"), _q_cols("util"), ["util"])


@register("cohort_behaviour", oracle="WITH " + _COHORT_SQL.lstrip() + """
SELECT amount, 'mobile_usage_score' AS metric, ROUND(mob_q25, 6) AS q25, ROUND(mob_q50, 6) AS q50, ROUND(mob_q75, 6) AS q75 FROM st
UNION ALL SELECT amount, 'transaction_stability_score', ROUND(txn_q25, 6), ROUND(txn_q50, 6), ROUND(txn_q75, 6) FROM st""",
          views=("risk_full", "questions"))
def cohort_behaviour(spark, sf_dir):
    c = _cohorts(views(spark, sf_dir), ["mob", "txn"])
    long = c.select("amount", F.explode(F.array(
        F.struct(F.lit("mobile_usage_score").alias("metric"), *[F.col(f"mob_q{q}").alias(f"q{q}") for q in (25, 50, 75)]),
        F.struct(F.lit("transaction_stability_score").alias("metric"),
                 *[F.col(f"txn_q{q}").alias(f"q{q}") for q in (25, 50, 75)]))).alias("r"))
    return round_doubles(long.select("amount", "r.*"))


_UNIT = "CAST({e} AS DOUBLE[])"


@register("semantic_topk", oracle="""
WITH ex AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, AVG(x) AS m FROM ex GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS qe FROM m GROUP BY 1),
d AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS de FROM embeddings),
s AS (SELECT query_id, doc_id,
        list_dot_product(qe, de) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(de, de))) AS score
      FROM q CROSS JOIN d)
SELECT CAST(query_id AS BIGINT) AS query_id, rank, doc_id, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) x WHERE rank <= 3""")
def semantic_topk(spark, sf_dir):
    """J9 + W8: top-3 documents for each label's centroid, over every embedding."""
    e = views(spark, sf_dir).t.embeddings.select("vec_id", "embedding", "label")
    docs = RT.normalized(e).select(F.col("vec_id").alias("doc_id"), "unit")
    queries = RT.centroids(e).select(F.col("query_id").cast("bigint").alias("query_id"), "unit")
    top = RT.topk_inner_product(queries, docs, k=3, exclude_self=False)
    return round_doubles(top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score"))


@register("nearest_documents", oracle="""
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) / (q.n * d.n) AS score FROM d q JOIN d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, ROUND(score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) x WHERE rank <= 3""")
def nearest_documents(spark, sf_dir):
    """J9 + W8 for a question's own vector: the three nearest other documents of every vector whose id is divisible by 20.

    (The scores of a query's ranks, as equal vectors tie within rounding.)
    """
    e = views(spark, sf_dir).t.embeddings.select("vec_id", "embedding")
    docs = RT.normalized(e).select(F.col("vec_id").alias("doc_id"), "unit").checkpoint()
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "unit")
    top = RT.topk_inner_product(queries, docs, k=3)
    return round_doubles(top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "score"))


def _decisions(v):
    """What answers need of each decision, written once per input version (the original reads it from its log)."""
    build = lambda: explained(v.spark, v.sf_dir, extra=["applicant_id", "submitted_at"]).select(
        "application_id", "applicant_id", "submitted_at", "decision",
        F.try_element_at(F.col("top_negative"), F.lit(1))["feature"].alias("main_negative_feature"))
    return v.stored("explained_decisions", build, [SC, EX, QE])


_CTX_SQL = """
ctx AS (SELECT q.question_id, arg_max(struct_pack(application_id := r.application_id, decision := d.decision,
                 main_negative_feature := n.feature), (r.submitted_at, r.application_id)) AS last
        FROM questions q JOIN risk_full r ON q.applicant_id = r.applicant_id AND CAST(r.submitted_at AS TIMESTAMP) <= q.asked_at
        JOIN dec d ON r.application_id = d.application_id
        LEFT JOIN (SELECT application_id, feature FROM ranked WHERE r_neg = 1) n ON r.application_id = n.application_id
        GROUP BY 1)"""


@register("question_context", oracle=f"""
WITH {_attr_sql()}, {_CTX_SQL}
SELECT q.question_id, q.applicant_id, ctx.last.application_id AS last_application_id, ctx.last.decision AS last_decision,
       ctx.last.main_negative_feature AS main_negative_feature
FROM questions q LEFT JOIN ctx ON q.question_id = ctx.question_id""", views=("risk_full", "questions"))
def question_context(spark, sf_dir):
    """The applicant's last decision at the time of the question."""
    v = views(spark, sf_dir)
    j = AD.decision_as_of(v.questions, _decisions(v))
    return j.select("question_id", "applicant_id", F.col("last.application_id").alias("last_application_id"),
                    F.col("last.decision").alias("last_decision"),
                    F.col("last.main_negative_feature").alias("main_negative_feature"))


# ---- the answers in SQL: the same fixed texts
def _lit(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _fill_sql(template: str, *values: str) -> str:
    parts = template.split("{}")
    return "(" + " || ".join([_lit(parts[0]), *[x for v, p in zip(values, parts[1:]) for x in (v, _lit(p))]]) + ")"


def _rupees_sql(e: str) -> str:
    return f"('₹' || printf('%,d', CAST(round_even({e}, 0) AS BIGINT)))"


def _three_sql(pre: str, digits: int) -> list[str]:
    return [f"printf('%.{digits}f', {pre}_q{q})" for q in (50, 25, 75)]


def _answers_sql() -> str:
    money = lambda pre: [_rupees_sql(f"{pre}_q{q}") for q in (50, 25, 75)]
    intro = lambda t: f"CASE WHEN amount IS NULL THEN {_lit(t[0])} ELSE {_fill_sql(t[1], _rupees_sql('amount'))} END"
    share = _fill_sql(AD.CREDIT_SHARE, "printf('%.0f', good_share * 100)")
    score = _fill_sql(AD.CREDIT_SCORE, *_three_sql("cibil", 0))
    mob = _fill_sql(AD.BEHAVIOUR, "'mobile_usage_score'", *_three_sql("mob", 0))
    txn = _fill_sql(AD.BEHAVIOUR, "'transaction_stability_score'", *_three_sql("txn", 0))
    texts = {
        "bank_balance": f"({intro(AD.BALANCE)}) || {_fill_sql(AD.BALANCE[2], *money('bal'))}",
        "income": f"({intro(AD.INCOME)}) || {_fill_sql(AD.INCOME[2], *money('inc'))}",
        "emi_ratio": _fill_sql(AD.RATIO, *_three_sql("ratio", 1)),
        "credit": f"CASE WHEN {share} IS NOT NULL OR {score} IS NOT NULL THEN concat_ws(' ', {share}, {score}, {_lit(AD.CREDIT_CLOSE)}) END",
        "behaviour": f"CASE WHEN {mob} IS NOT NULL OR {txn} IS NOT NULL THEN concat_ws(' ', {mob}, {txn}, {_lit(AD.BEHAVIOUR_CLOSE)}) END",
        "utilisation": _fill_sql(AD.UTILISATION, *_three_sql("util", 1)),
    }
    return " UNION ALL ".join(f"SELECT amount, '{i}' AS intent, {t} AS cohort_answer FROM st" for i, t in texts.items())


def _tokens_sql(t: str) -> str:
    return (f"list_distinct(list_filter(string_split(lower(regexp_replace({t}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))")


_GUIDE_SQL = f"""
guide(i, t) AS (VALUES {", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(RT.GUIDANCE))}),
scored AS (SELECT source, item_id, turn, i, t,
  len(list_intersect({_tokens_sql('text')}, {_tokens_sql('t')})) / greatest(sqrt(len({_tokens_sql('text')}) * len({_tokens_sql('t')})), 1.0e0) AS s
  FROM texts CROSS JOIN guide),
bullets AS (SELECT source, item_id, turn, string_agg('- ' || t, chr(10) ORDER BY s DESC, i) AS b FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source, item_id, turn ORDER BY s DESC, i) AS rn FROM scored) z WHERE rn <= 3 GROUP BY 1, 2, 3)"""


@register("advice_answers", oracle=f"""
WITH {_attr_sql()}, {_CTX_SQL}, {_COHORT_SQL}, answers AS ({_answers_sql()}), {_GUIDE_SQL},
asked AS (SELECT source, item_id, turn, text, COALESCE({_KW_SQL}, FALSE) AS is_banking, {_intent_sql('text')} AS intent,
                 {_AMOUNT_SQL.format(t='text')} AS amount FROM texts)
SELECT a.source, a.item_id, a.turn, a.intent,
  CASE WHEN NOT a.is_banking THEN {_lit(AD.REFUSAL)}
       ELSE COALESCE(w.cohort_answer, {_lit(AD.RETRIEVAL_BASE)} || chr(10) || b.b
         || CASE WHEN ctx.last.decision IS NOT NULL AND ctx.last.main_negative_feature IS NOT NULL
                 THEN {_fill_sql(AD.CONTEXT_NOTE, 'ctx.last.main_negative_feature')} ELSE '' END || {_lit(AD.FOLLOW_UP)}) END AS answer
FROM asked a LEFT JOIN answers w ON a.intent = w.intent AND a.amount IS NOT DISTINCT FROM w.amount
LEFT JOIN bullets b ON a.source = b.source AND a.item_id = b.item_id AND a.turn = b.turn
LEFT JOIN ctx ON a.source = 'question' AND a.item_id = ctx.question_id""", views=("risk_full", "questions"))
def advice_answers(spark, sf_dir):
    """The answer to every question and user turn (gate, cohort answer, or retrieval with context)."""
    v = views(spark, sf_dir)
    ctx = AD.decision_as_of(v.questions.select("question_id", "applicant_id", "asked_at"), _decisions(v)).select(
        F.lit("question").alias("_s"), F.col("question_id").alias("_q"), F.col("last.decision").alias("last_decision"),
        F.col("last.main_negative_feature").alias("main_negative_feature"))
    t = _texts(v)
    asked = t.select("source", "item_id", "turn", F.col("text").alias("question"), TX.is_banking(F.col("text")).alias("is_banking"),
                     TX.intent(F.col("text")).alias("intent"), TX.loan_amount(F.col("text")).alias("amount"))
    asked = asked.join(ctx, (F.col("source") == F.col("_s")) & (F.col("item_id") == F.col("_q")), "left").drop("_s", "_q")
    return AD.answers(asked, _cohorts(v)).select("source", "item_id", "turn", "intent", "answer")
