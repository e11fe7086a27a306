"""Data of study sheets as JSON: schemas, checks of what must be there, and a writer.

Data is read, never run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An analysis sheet: highlights are phrase, colour and label.
ANALYSIS = (
    "meta struct<lesson_title:string,source_label:string,badge_label:string,logo_text:string>, "
    "sentences array<struct<en:string,ko:string,note:string,star:boolean,section:string,spacer:boolean,divider:boolean,highlights:array<struct<phrase:string,color:string,label:string>>>>"
)
#: A question; what its type does not have is null.
_QUESTION = (
    "num:int,type:string,question:string,choices:array<string>,answer:string,answer_display:string,key_phrases:array<string>,explanation:string,"
    "korean:string,conditions:array<string>,insert_sentence:string,passage_underlined:string,passage_abc:string"
)
#: An exam; one with a passage and questions alone is read as one section.
EXAM = (
    "info struct<source_label:string,round:string,output_filename:string,output_dir:string>, "
    f"sections array<struct<label:string,passage:string,questions:array<struct<{_QUESTION}>>>>, passage string, questions array<struct<{_QUESTION}>>"
)
#: A vocabulary test.
VOCABULARY = "meta struct<source_label:string,lesson_title:string,output_filename:string,words_per_col:int>, words array<struct<num:int,en:string,ko:string>>"
LONE_SECTION = "다음 글을 읽고 물음에 답하시오."


def _checked(df: DataFrame, problems: list[tuple[Column, str]], column: str) -> DataFrame:
    """Fails, when a row is read, with all that is wrong in it."""
    wrong = F.concat_ws("; ", *[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in problems])
    return df.withColumn(column, F.when(wrong == "", F.col(column)).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": "), wrong)).cast(df.schema[column].dataType)))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """(meta, sentences, file); all of the meta data must be there."""
    df = _read(spark, path, ANALYSIS)
    return _checked(df, [(F.col(f"meta.{k}").isNull(), f"meta.{k} is missing") for k in ("lesson_title", "source_label", "badge_label", "logo_text")], "sentences")


def read_exams(spark: SparkSession, path: str) -> DataFrame:
    """(info, sections, file); a source label and whole sections must be there."""
    df = _read(spark, path, EXAM)
    lone = F.array(F.struct(F.lit(LONE_SECTION).alias("label"), F.col("passage").alias("passage"), F.col("questions").alias("questions")))
    df = df.withColumn("sections", F.coalesce("sections", F.when(F.col("passage").isNotNull() & F.col("questions").isNotNull(), lone))).drop("passage", "questions")
    whole = F.forall("sections", lambda s: s["label"].isNotNull() & s["passage"].isNotNull() & s["questions"].isNotNull())
    return _checked(df, [(F.col("info.source_label").isNull(), "info.source_label is missing"), (~(F.size("sections") > 0), "sections are missing"), (~whole, "a section lacks label, passage or questions")], "sections")


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """(meta, words, file); meta data and words, each with number and both languages, must be there."""
    whole = F.forall("words", lambda w: w["num"].isNotNull() & w["en"].isNotNull() & w["ko"].isNotNull())
    missing = [(F.col(f"meta.{k}").isNull(), f"meta.{k} is missing") for k in ("source_label", "lesson_title", "output_filename")]
    return _checked(_read(spark, path, VOCABULARY), [*missing, (~(F.size("words") > 0), "words are missing"), (~whole, "a word lacks num, en or ko")], "words")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; empty fields stay, and so do letters outside ASCII."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
