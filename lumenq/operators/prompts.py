"""Dataset adapters, prompts, few-shot prefixes and the expansion of prompts to samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.config import DATASETS
from lumenq.functions.text import judge_score, marked_number, normalize_aliases, strip

C = F.col


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _id(name: str) -> Column:
    """An id as text; an absent one is the text None."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _required(value: Column, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def _documents(docs: Column) -> Column:
    """Numbered documents of (title, body)."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Document "), i.cast("string"), F.lit(": "), F.coalesce(d["title"], F.lit("")), F.lit("\n"), F.coalesce(d["body"], F.lit("")), F.lit("\n\n"))), "")


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _listed(values: Column) -> Column:
    """Values that are neither null nor empty, joined by commas."""
    return F.array_join(F.filter(values, lambda a: a.isNotNull() & (a != "")), ", ")


@dataclass(frozen=True)
class Adapter:
    """A dataset's extraction and texts as column builders; judge is None where answers are matched exactly."""

    sample: Callable[[DataFrame], DataFrame]
    prompt: Callable[[Column], Column]
    shot: Callable[[], Column]
    shots: Callable[[Column], Column]
    judge: Callable[[], Column] | None = None
    parse: Callable[[Column], Column] = judge_score


def _plain_shots(title: str) -> Callable[[Column], Column]:
    """Shots, each ending in a blank line, after a title if there are any."""
    return lambda shots: F.when(F.size(shots) > 0, _join(title, F.array_join(shots, ""))).otherwise("")


def _parted_shots(title: str, end: str = "") -> Callable[[Column], Column]:
    """Shots with blank lines between them, after a title if there are any."""
    return lambda shots: F.when(F.size(shots) > 0, _join(title, F.array_join(shots, "\n\n"), end)).otherwise("")


# The prompts' wording, word for word.
_QA_SHOT = lambda: _join("Question: ", C("question"), "\nAnswer: ", C("reference_answer"), "\n\n")
_QA_JUDGE = "Task : You evaluate whether the model response correctly answers the question.\nAccept conversational hedges if the core answer matches any reference alias.\n"
_QA_JUDGE_END = "Answer only 0 (incorrect or uncommitted) or 1 (correct).\nOutput a single digit, nothing else.\nScore:"
_GIVEN = "The following are the given documents:\n\n"
_STRICTLY = "Answer the question based strictly on the provided documents.\n\n"
_REASON = 'Given the following question, reason and give a final answer to the question. Your response should end with "#### [answer]" where [answer] is the response to the question.\n\n'
_ONE_SENTENCE = "Provide a short one-sentence summary for the following text."
_DIALOGUE = "Provide a summary for the following dialogue. The summary should (1) be rather short, (2) extract important pieces of information, (3) include names of interlocutors, (4) be written in the third person."
_TRANSLATE = "Translate the following French text into English, give only the translation.\n\n"
_TRANSLATION_JUDGE = "Task : You evaluate the quality of a machine translation from French to English.\n\n"
_TRANSLATION_JUDGE_END = "Ignore stylistic differences. Answer only 0 (critical semantic error or hallucination) or         1 (meaning preserved).\nOutput a single digit, nothing else.\nScore:"
_CONSISTENT = "No hallucinations or contradictions allowed. Answer only 0 (inconsistent) or 1 (consistent).\nOutput a single digit, nothing else.\nScore:"


def _summary(kind: str, field: str, instruction: str, task: str, title: str) -> Adapter:
    """A summarisation dataset of field -> summary."""
    head = f"Here's the {kind}:\n"
    tail = f"\n(End of {kind}).\n\nSummary:"
    shown = lambda: _join(head, C("question"), tail)
    return Adapter(
        sample=lambda d: d.select(strip(_required(C(field), f"{field} is missing")).alias("question"), strip(_required(C("summary"), "summary is missing")).alias("reference_answer"), _id("id").alias("id")),
        prompt=lambda prefix: strip(_join(instruction, "\n\n", F.when(prefix != "", _join(strip(prefix), "\n\n")).otherwise(""), shown())),
        shot=lambda: _join(shown(), " ", C("reference_answer")),
        shots=_parted_shots("Here are some examples:\n"),
        judge=lambda: _join(task, f"{title}: \n", C("question"), "\n\nSummary: ", C("raw_answer"), "\n\n", _CONSISTENT),
    )


def _multi_hop(sample: Callable[[DataFrame], DataFrame], acceptable: Callable[[], Column]) -> Adapter:
    return Adapter(
        sample=sample,
        prompt=lambda prefix: _join(_GIVEN, _documents(C("source_documents")), _STRICTLY, prefix, "Question: ", C("question"), "\nAnswer:"),
        shot=_QA_SHOT,
        shots=_plain_shots(""),
        judge=lambda: _join(_QA_JUDGE, "Question: ", C("question"), "\n", acceptable(), "\nModel response: ", C("raw_answer"), "\n", _QA_JUDGE_END),
    )


def _hotpot(d: DataFrame) -> DataFrame:
    """Titles zipped with their joined sentences; rows without titles are dropped, unequal lengths are an error."""
    titles, sentences = F.coalesce("context.title", F.array().cast("array<string>")), F.coalesce("context.sentences", F.array().cast("array<array<string>>"))
    docs = F.when(C("context").isNull(), F.raise_error(F.lit("context is missing")).cast("array<struct<title:string,body:string>>"))
    docs = docs.when((F.size(titles) > 0) & (F.size(titles) != F.size(sentences)), F.raise_error(F.lit("titles and sentences differ in number")).cast("array<struct<title:string,body:string>>"))
    docs = docs.otherwise(F.zip_with(titles, sentences, lambda t, s: F.struct(t.alias("title"), F.array_join(s, "").alias("body"))))
    return d.select(strip(_text("question")).alias("question"), strip(_text("answer")).alias("reference_answer"), docs.alias("source_documents"), _id("id").alias("id")).where(F.size("source_documents") > 0)


def _musique(d: DataFrame) -> DataFrame:
    docs = F.when(F.coalesce(F.size("paragraphs"), F.lit(0)) < 1, F.raise_error(F.lit("paragraphs are missing")).cast("array<struct<title:string,body:string>>"))
    docs = docs.otherwise(F.transform("paragraphs", lambda p: F.struct(p["title"].alias("title"), p["paragraph_text"].alias("body"))))
    return d.select(strip(_text("question")).alias("question"), strip(_text("answer")).alias("reference_answer"), docs.alias("source_documents"), _id("id").alias("id"), normalize_aliases(C("answer_aliases")).alias("aliases"))


def _gsm(d: DataFrame) -> DataFrame:
    answer = strip(_required(C("answer"), "answer is missing"))
    return d.select(strip(_required(C("question"), "question is missing")).alias("question"), marked_number(answer).alias("reference_answer"), answer.alias("raw_reference_answer"))


def _trivia(d: DataFrame) -> DataFrame:
    """The answer is a struct of value and aliases, or a bare string."""
    structured = "struct" in d.schema["answer"].dataType.simpleString()
    aliases = normalize_aliases(C("answer.aliases")) if structured else F.array().cast("array<string>")
    return d.select(_text("question").alias("question"), (_text("answer.value") if structured else C("answer")).alias("reference_answer"), aliases.alias("aliases"), _id("question_id").alias("id"))


def _wmt(d: DataFrame) -> DataFrame:
    """A translation struct, or flat columns fr and en."""
    at = "translation." if "translation" in d.columns else ""
    return d.select(strip(_required(C(at + "fr"), "fr is missing")).alias("question"), strip(_required(C(at + "en"), "en is missing")).alias("reference_answer"), F.lit("fr").alias("source_language"), F.lit("en").alias("target_language"))


def _aliases() -> Column:
    return F.coalesce(C("aliases"), F.array().cast("array<string>"))


ADAPTERS = {
    "gsm8k": Adapter(
        sample=_gsm,
        prompt=lambda prefix: _join(_REASON, prefix, "Question: ", C("question"), "\nAnswer:"),
        shot=lambda: _join("Question: ", C("question"), "\nAnswer: ", C("raw_reference_answer")),
        shots=_parted_shots("Here are a few examples of questions and answers:\n", "\n\n"),
        parse=marked_number,
    ),
    "triviaqa": Adapter(
        sample=_trivia,
        prompt=lambda prefix: _join(prefix, "Question: ", C("question"), "\nAnswer:"),
        shot=_QA_SHOT,
        shots=_plain_shots(""),
        judge=lambda: _join(_QA_JUDGE, "Question: ", C("question"), "\nAcceptable response(s): ", _listed(F.when(F.size(_aliases()) > 0, _aliases()).otherwise(F.array("reference_answer"))), "\nModel response: ", C("raw_answer"), "\n", _QA_JUDGE_END),
    ),
    "wmt14_fr_en": Adapter(
        sample=_wmt,
        prompt=lambda prefix: _join(_TRANSLATE, prefix, "Original: ", C("question"), "\nTranslation:"),
        shot=lambda: _join("Original: ", C("question"), "\nTranslation: ", C("reference_answer"), "\n\n"),
        shots=_plain_shots("Here are a few examples:\n\n"),
        judge=lambda: _join(_TRANSLATION_JUDGE, "French original: ", C("question"), "\nEnglish translation: ", C("raw_answer"), "\n", _TRANSLATION_JUDGE_END),
    ),
    "xsum": _summary("text", "document", _ONE_SENTENCE, "Task : You evaluate the consistency of a summary with the source document.\n\n", "Document"),
    "samsum": _summary("dialogue", "dialogue", _DIALOGUE, "Task : You evaluate the consistency of a summary with the source dialogue.\n\n", "Dialogue"),
    "hotpotqa": _multi_hop(_hotpot, lambda: _join("Acceptable response: ", C("reference_answer"))),
    "musique": _multi_hop(_musique, lambda: _join("Acceptable response(s): ", _listed(F.concat(F.array("reference_answer"), _aliases())))),
}


def adapter(dataset: str) -> Adapter:
    if dataset not in ADAPTERS:
        raise ValueError(f"unknown dataset {dataset}; there are {', '.join(DATASETS)}")
    return ADAPTERS[dataset]


def fewshot_prefix(samples: DataFrame, dataset: str, k: int, order: str = "ord") -> DataFrame:
    """One row: the prefix of the first k samples by order; empty without any."""
    own = adapter(dataset)
    shots = samples.orderBy(order).limit(k).select(order, own.shot().alias("shot"))
    return shots.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "shot"))), lambda s: s["shot"]).alias("shots")).select(own.shots(C("shots")).alias("prefix"))


def numbered(samples: DataFrame, order: str) -> DataFrame:
    """samples with at, their place by order from 0: exact, and without a window over the whole table."""
    from lumenq.operators.prefix import prefix_sums

    one = samples.withColumns({"__all": F.lit(0), "__one": F.lit(1).cast("bigint")})
    return prefix_sums(one, ["__all"], order, ["__one"]).withColumn("at", C("__one_before")).drop("__all", "__one", "__one_before")


def build_prompts(raw: DataFrame, dataset: str, k: int = 0, n: int = 1000, order: str = "ord") -> DataFrame:
    """prompt_id, dataset, prompt_text and the sample's fields: the first k samples are shots, the next n are asked.

    order is numeric and distinct. Dropped samples do not count. An error if no question is left.
    """
    own = adapter(dataset)
    fields = own.sample(raw)
    with_order = _carry(raw, own, order)
    placed = numbered(with_order, order)
    prefix = fewshot_prefix(with_order, dataset, k, order).select("prefix") if k else None
    asked = placed.where((C("at") >= k) & (C("at") < k + n))
    asked = asked.crossJoin(F.broadcast(prefix)) if k else asked.withColumn("prefix", F.lit(""))  # one row
    return asked.select((C("at") - k).alias("prompt_id"), F.lit(dataset).alias("dataset"), own.prompt(C("prefix")).alias("prompt_text"), *fields.columns)


def _carry(raw: DataFrame, own: Adapter, order: str) -> DataFrame:
    """The adapter's sample with the order column kept beside its fields."""

    class Keeping:
        """Passes select on with the order column added."""

        def __init__(self, df):
            self.df = df

        schema = property(lambda self: self.df.schema)
        columns = property(lambda self: self.df.columns)

        def select(self, *columns):
            return self.df.select(*columns, order)

    return own.sample(Keeping(raw))


def judge_prompts(records: DataFrame, dataset: str, output: str = "judge_prompt") -> DataFrame:
    own = adapter(dataset)
    if own.judge is None:
        raise ValueError(f"{dataset} is labelled by exact match")
    return records.withColumn(output, own.judge())


def expand_samples(prompts: DataFrame, samples: int, greedy: bool = True, order: str = "prompt_id") -> DataFrame:
    """1 + samples rows a prompt with greedy, else samples: response_sample_id, generation_mode, qa_example_id, sample_example_id.

    Sample 0 is the greedy one. The example id is the first of the id columns that is not blank, else the order; a
    number is added where there are several samples. One sample a prompt passes through.
    """
    total = samples + 1 if greedy else samples
    known = [c for c in ("sample_example_id", "id", "example_id", "question_id") if c in prompts.columns]
    example = F.coalesce(*[F.when(strip(C(c).cast("string")) != "", C(c).cast("string")) for c in known], C(order).cast("string"))
    out = prompts.withColumn("qa_index", C(order).cast("int")).withColumn("qa_example_id", example)
    if total <= 1:
        return out.withColumns({"response_sample_id": F.lit(0), "num_response_samples": F.lit(1), "generation_mode": F.lit("greedy" if greedy else "sampled"), "sample_example_id": C("qa_example_id")})
    out = out.withColumn("response_sample_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    mode = F.when(F.lit(greedy) & (C("response_sample_id") == 0), "greedy").otherwise("sampled")
    return out.withColumns({"num_response_samples": F.lit(total), "generation_mode": mode, "sample_example_id": F.concat(C("qa_example_id"), F.lit("::sample_"), C("response_sample_id").cast("string"))})


def group_key(records: DataFrame, per_prompt: int, order: str = "sample_id") -> DataFrame:
    """records with prompt_id: the example id, else the place of its run of per_prompt records."""
    by_place = F.floor(C(order) / per_prompt).cast("string")
    own = C("qa_example_id").cast("string") if "qa_example_id" in records.columns else F.lit(None).cast("string")
    return records.withColumn("prompt_id", F.coalesce(own, by_place))


def partition_greedy(records: DataFrame, key: str = "prompt_id", order: str = "sample_id", mode: str = "generation_mode") -> DataFrame:
    """records with is_greedy: the last greedy record of a prompt, or its first record if none is greedy."""
    chosen = records.groupBy(key).agg(F.coalesce(F.max(F.when(C(mode) == "greedy", C(order))), F.min(order)).alias("__chosen"))
    return records.join(chosen, key).withColumn("is_greedy", C(order) == C("__chosen")).drop("__chosen")


def final_answer(record: list[str]) -> Column:
    """The stripped raw answer, else final.answer, else final.response, of those columns that there are."""
    known = [c for c in ("raw_answer", "final.answer", "final.response") if c.split(".")[0] in record]
    return F.coalesce(*[strip(C(c).cast("string")) for c in known], F.lit(""))


def answer_records(samples: DataFrame, answers: DataFrame, order: str = "ord") -> DataFrame:
    """Samples joined with their answers by ordinal; sample_id is the ordinal, empty aliases become the reference."""
    joined = samples.join(answers.select(order, "raw_answer", *[c for c in ("parsed_answer",) if c in answers.columns]), order)
    if "aliases" in samples.columns:
        joined = joined.withColumn("aliases", F.when(F.size(_aliases()) > 0, C("aliases")).otherwise(F.array(C("reference_answer").cast("string"))))
    return joined.withColumn("sample_id", C(order).cast("int")).withColumn("label", F.lit(None).cast("boolean"))


def interleave(greedy: DataFrame, sampled: DataFrame, samples: int, order: str = "ord") -> DataFrame:
    """One greedy row and then samples rows a question as one table with sample_id in that order."""
    g = greedy.withColumn("sample_id", C(order) * (samples + 1))
    s = sampled.withColumn("sample_id", F.floor(C(order) / samples) * (samples + 1) + 1 + C(order) % samples)
    return g.unionByName(s, allowMissingColumns=True).withColumn("sample_id", C("sample_id").cast("bigint"))


def load_prompts(spark: SparkSession, path: str, schema=None) -> tuple[str, DataFrame]:
    """(dataset, samples with prompt_text as raw_prompt) of a prompts file; an error if it is empty."""
    from lumenq.sources.files import read_jsonl

    rows = read_jsonl(spark, path, schema)
    first = rows.select("dataset").head()
    if first is None:
        raise ValueError(f"no prompts in {path}")
    return first[0], rows.withColumn("raw_prompt", C("prompt_text")).drop("prompt_id", "dataset", "prompt_text")


def first_records(records: DataFrame, key: str = "prompt_id", order: str = "sample_id") -> DataFrame:
    """The first record of each prompt."""
    w = Window.partitionBy(key).orderBy(order)
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
