"""Prompt construction for multiple-choice questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.parsing import CHOICES, subject_title

# ---- fixed values: prompt texts of the reference ---------------------------------------
DEFAULT_SYSTEM = ("You will be given multiple choice questions. Please reply with a single character "
                  "'A', 'B', 'C', or 'D' only. DO NOT explain your reply.")
OPEN_SYSTEM = "Keep your replies short and to the point."
FEW_SHOT_HEADER = "The following are multiple choice questions (with answers) about {subject}.\n\n"
FEW_SHOT_INSTRUCTION = ("For the next multiple choice question, answer as above by choosing the correct "
                        "answer 'A', 'B', 'C' or 'D'.\n\n")
ANSWER_CUE = "Answer:"


def question_block(question="question", choices="choices") -> Column:
    """Question line, one 'X. choice' line per choice, then 'Answer:'."""
    letters = F.array(*[F.lit(c) for c in CHOICES])
    lines = F.zip_with(letters, F.col(choices), lambda l, c: F.concat(l, F.lit(". "), c, F.lit("\n")))
    return F.concat(F.col(question), F.lit("\n"), F.array_join(lines, ""), F.lit(ANSWER_CUE))


def few_shot_texts(dev: DataFrame) -> DataFrame:
    """Per subject, the header and every dev example in dev order, as one text.

    The dev split is the few-shot example set; the reference puts all of a subject's
    examples into one prompt, so its size is what a prompt holds."""
    example = F.concat(question_block(), F.element_at(F.array(*[F.lit(c) for c in CHOICES]), F.col("answer") + 1),
                       F.lit("\n\n"))
    g = dev.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("qid", example.alias("ex")))).alias("exs"))
    header = F.concat(F.lit(FEW_SHOT_HEADER.split("{subject}")[0]), subject_title("subject"),
                      F.lit(FEW_SHOT_HEADER.split("{subject}")[1]))
    return g.select("subject", F.concat(header, F.array_join(F.transform("exs", lambda x: x["ex"]), "")).alias("shots"))


def format_prompts(questions: DataFrame, dev: DataFrame | None = None, system: str = DEFAULT_SYSTEM,
                   few_shot: int = 0, few_shot_system: bool = False) -> DataFrame:
    """P4 + P6 + J1: (qid, query, system) for every question.

    ``few_shot > 0`` prepends the subject's examples (all of them: the count only
    switches the feature on); with ``few_shot_system`` the examples and a fixed
    instruction become the system prompt and the query is the bare question."""
    q = questions.select("qid", "subject", question_block().alias("block"))
    if few_shot > 0:
        q = q.join(few_shot_texts(dev), "subject", "left")
        shots_col = F.coalesce(F.col("shots"), F.concat(F.lit(FEW_SHOT_HEADER.split("{subject}")[0]),
                                                        subject_title("subject"),
                                                        F.lit(FEW_SHOT_HEADER.split("{subject}")[1])))
    else:
        shots_col = F.lit("")
    if few_shot_system:
        return q.select("qid", F.col("block").alias("query"),
                        F.concat(shots_col, F.lit(FEW_SHOT_INSTRUCTION)).alias("system"))
    return q.select("qid", F.concat(shots_col, F.col("block")).alias("query"), F.lit(system).alias("system"))


def chat_messages(prompts: DataFrame) -> DataFrame:
    """Chat of each prompt as array<struct<role, content>>: system then user."""
    return prompts.select("*", F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))).alias("chat"))


# ---- U2: prompt formatter per data set --------------------------------------------------

FORMATTERS: dict[str, Callable[..., DataFrame]] = {}


def formatter(name: str):
    """Register a formatter for the data set ``name``: questions and options -> (key, query, system), one row a question."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in FORMATTERS:
            raise ValueError(f"a formatter for {name!r} is registered")
        FORMATTERS[name] = fn
        return fn

    return add


def prompts(dataset: str, questions: DataFrame, **options) -> DataFrame:
    """The prompts of ``questions`` by the formatter of their data set."""
    if dataset not in FORMATTERS:
        raise ValueError(f"no formatter for {dataset!r}; there are {', '.join(sorted(FORMATTERS))}")
    return FORMATTERS[dataset](questions, **options)


formatter("mmlu")(format_prompts)


@formatter("lmsys")
def format_open_questions(questions: DataFrame, system: str = OPEN_SYSTEM) -> DataFrame:
    """(pos, query, system) of open questions: the question is the prompt as it stands."""
    return questions.select("pos", F.col("question").alias("query"), F.lit(system).alias("system"))
