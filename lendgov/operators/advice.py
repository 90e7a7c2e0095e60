"""Answer composition for loan questions.

The cohort texts depend on (intent, amount) alone: they are written on the small table of
amounts and joined to the questions. A question that gets none is answered by retrieval, with
its applicant's last decision before the question was asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import last_known
from ..functions.text import fixed, rupees
from .retrieval import guidance_topk

# Answer texts.
REFUSAL = ("I am designed only to help with banking and loan-related queries, such as EMIs, credit history, "
           "loan approval factors and risk. I cannot answer questions outside of banking.")
RETRIEVAL_BASE = ("Here are some practical steps you can take regarding your loan application, "
                  "based on general credit risk practices:")
FOLLOW_UP = ("\n\nThese are general recommendations and not legal or financial advice. "
             "Please review them with your bank or a qualified advisor before taking decisions.")


def decision_as_of(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each question with its applicant's last decision made no later than it was asked.

    questions: (question_id, applicant_id, asked_at, ...); decisions: (applicant_id, submitted_at,
    application_id, decision, main_negative_feature). Both are put in one order by (applicant, time) and every
    question takes the last decision before it; an applicant with many of both is spread over ranges.
    """
    last = F.struct("application_id", "decision", "main_negative_feature")
    events = decisions.select("applicant_id", F.col("submitted_at").cast("timestamp_ntz").alias("at"), F.lit(0).alias("kind"),
                              F.col("application_id").alias("tie"), last.alias("last"), F.lit(None).cast("string").alias("asker")) \
        .unionByName(questions.select("applicant_id", F.col("asked_at").cast("timestamp_ntz").alias("at"), F.lit(1).alias("kind"),
                                      F.lit(0).cast("bigint").alias("tie"), F.lit(None).cast(decisions.select(last.alias("l")).schema["l"].dataType).alias("last"),
                                      F.col("question_id").cast("string").alias("asker")))
    filled = last_known(events, ["applicant_id"], ["at", "kind", "tie", "asker"], "last")
    found = filled.where(F.col("kind") == 1).select(F.col("asker").alias("_q"), F.col("last_known").alias("last"))
    return questions.join(found, F.col("question_id").cast("string") == F.col("_q"), "left").drop("_q")


# The parts of the cohort answers, in order; {} stands for a number.
BALANCE = ("For this kind of loan profile, you should aim to maintain an average bank balance",
           "For a loan amount roughly around {}, you should aim to maintain an average bank balance",
           " of about {}. In many approved cases, balances between approximately {} and {} have been sufficient. "
           "Keeping a higher and more stable balance will generally strengthen your "
           "profile, but final approval still depends on income, EMI, credit history and other factors.")
INCOME = ("For this type of loan, you should target a combined monthly income",
          "For a loan amount roughly around {}, you should target a combined monthly income",
          " of around {}. In practice, many accepted customers have incomes in the range of roughly {} to {}"
          ". Higher and more stable income improves approval odds, especially when EMI stays well below "
          "40% of income.")
RATIO = ("For healthy profiles, you should aim for an income-to-EMI ratio of around {}, with many good cases falling between about {} and {}"
         ". This roughly corresponds to EMIs staying comfortably below 35–40% of take-home income in "
         "most situations.")
CREDIT_SHARE = ("A strong credit history is important. In many accepted cases, roughly {}"
                "% had a clean track record with no major defaults.")
CREDIT_SCORE = ("As a broad guide, a proxy credit score around {}, with many good cases between {} and {}"
                ", is considered healthier for approval.")
CREDIT_CLOSE = ("Maintaining on-time payments, low overdue amounts and avoiding cheque bounces are key to keeping "
                "scores in a healthy band.")
BEHAVIOUR = "You should aim for {} around {}, with a comfortable zone roughly between {} and {}."
BEHAVIOUR_CLOSE = ("Consistent usage of the same primary SIM and regular salary/business credits into one main "
                   "account tend to support stronger behavioural scores.")
UTILISATION = ("As a guideline, you should try to keep overall credit utilisation around {}x of your reference balances, "
               "with a safer zone roughly between {}x and {}"
               "x. Lower utilisation (for example keeping card and loan limits only partly used) usually signals "
               "lower risk.")
CONTEXT_NOTE = ("\n\nFrom your last automated decision, the most important factor that reduced your approval score was '{}"
                "'. Focus on improving that specific aspect (for example by lowering related dues, improving "
                "repayment discipline, or strengthening income stability).")


def filled_in(template: str, *values) -> Column:
    """The template with its {} replaced in order; null if a value is null."""
    parts = [F.lit(p) for p in template.split("{}")]
    return F.concat(parts[0], *[x for pair in zip(values, parts[1:]) for x in pair])


def _three(pre: str, digits: int) -> list[Column]:
    """Median and quartiles of a statistic as text."""
    return [fixed(F.col(f"{pre}_q{q}"), digits) for q in (50, 25, 75)]


def _money(pre: str) -> list[Column]:
    return [rupees(F.col(f"{pre}_q{q}")) for q in (50, 25, 75)]


def cohort_texts() -> dict[str, Column]:
    """The cohort answer of each intent over one amount's statistics; null where the statistics are missing."""
    a = F.col("amount")
    intro = lambda t: F.when(a.isNull(), F.lit(t[0])).otherwise(filled_in(t[1], rupees(a)))
    share = filled_in(CREDIT_SHARE, fixed(F.col("good_share") * 100, 0))
    score = filled_in(CREDIT_SCORE, *_three("cibil", 0))
    mobile, transactions = (filled_in(BEHAVIOUR, F.lit(name), *_three(pre, 0)) for name, pre in (
        ("mobile_usage_score", "mob"), ("transaction_stability_score", "txn")))
    return {
        "bank_balance": F.concat(intro(BALANCE), filled_in(BALANCE[2], *_money("bal"))),
        "income": F.concat(intro(INCOME), filled_in(INCOME[2], *_money("inc"))),
        "emi_ratio": filled_in(RATIO, *_three("ratio", 1)),
        "credit": F.when(share.isNotNull() | score.isNotNull(), F.concat_ws(" ", share, score, F.lit(CREDIT_CLOSE))),
        "behaviour": F.when(mobile.isNotNull() | transactions.isNotNull(), F.concat_ws(" ", mobile, transactions, F.lit(BEHAVIOUR_CLOSE))),
        "utilisation": filled_in(UTILISATION, *_three("util", 1)),
    }


def cohort_answers(stats: DataFrame) -> DataFrame:
    """(amount, intent, cohort_answer): the texts depend on the amount alone, so they are written on the small amount table."""
    texts = F.explode(F.array(*[F.struct(F.lit(i).alias("intent"), t.alias("cohort_answer")) for i, t in cohort_texts().items()]))
    return stats.select("amount", texts.alias("r")).select("amount", "r.intent", "r.cohort_answer")


def retrieval_answer(text_col: str = "question"):
    """Base line, three guidance bullets, optional last-decision note, disclaimer."""
    bullets = F.array_join(F.transform(guidance_topk(F.col(text_col)), lambda s: F.concat(F.lit("- "), s)), "\n")
    known = F.col("last_decision").isNotNull() & F.col("main_negative_feature").isNotNull()
    note = F.when(known, filled_in(CONTEXT_NOTE, F.col("main_negative_feature"))).otherwise(F.lit(""))
    return F.concat(F.lit(RETRIEVAL_BASE + "\n"), bullets, note, F.lit(FOLLOW_UP))


def answers(questions: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``answer`` to questions (is_banking, intent, amount, question, last_decision, main_negative_feature)."""
    texts = cohort_answers(stats).select(F.col("amount").alias("_a"), F.col("intent").alias("_i"), "cohort_answer")
    j = questions.join(texts, questions["amount"].eqNullSafe(F.col("_a")) & (questions["intent"] == F.col("_i")), "left")
    text = F.when(~F.col("is_banking"), F.lit(REFUSAL)).otherwise(F.coalesce("cohort_answer", retrieval_answer()))
    return j.withColumn("answer", text).drop("_a", "_i", "cohort_answer")
