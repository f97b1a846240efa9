"""Reading model responses: JSON text in, typed columns with defaults out.

A response counts as an answer when it is a non-empty JSON object.  Values are
read through VARIANT because models return numbers as text and lists as text.
Spark's parser overlooks text after the object; a Python responder's answers
have been checked whole before (operators/ask.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

JOINT = "; "


def parsed(response: Column) -> Column:
    return F.try_parse_json(response)


def is_answer(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """Text of a field, lists joined; null when the field is missing or null."""
    return F.coalesce(
        F.array_join(F.try_variant_get(value, path, "array<string>"), JOINT),
        F.try_variant_get(value, path, "string"),
    )


def list_at(value: Column, path: str) -> Column:
    """A field as a list of texts: a list as it is, a text as a list of one."""
    as_text = F.try_variant_get(value, path, "string")
    return F.coalesce(
        F.try_variant_get(value, path, "array<string>"),
        F.when(as_text.isNotNull(), F.array(as_text)),
    )


def with_score(df: DataFrame, min_score: float = 3.0, response: str = "response") -> DataFrame:
    """score, reason, match_keywords, passed, response_ok from a scoring response.

    A failed call and a missing or null score both give score 1; ``response_ok``
    tells them apart.  Scores are not clamped and may be fractional.
    """
    v = F.col("_answer")
    ok = F.col("response_ok")
    return (
        df.withColumn("_answer", parsed(F.col(response)))
        .withColumn("response_ok", is_answer(v))
        .withColumns(
            {
                "score": F.coalesce(F.when(ok, F.try_variant_get(v, "$.score", "double")), F.lit(1.0)),
                "reason": F.coalesce(F.when(ok, text_at(v, "$.reason")), F.lit("")),
                "match_keywords": F.coalesce(F.when(ok, text_at(v, "$.keywords")), F.lit("")),
            }
        )
        .withColumn("passed", F.col("score") >= F.lit(float(min_score)))
        .drop("_answer", response)
    )


def with_classes(df: DataFrame, mode: str = "single", response: str = "response") -> DataFrame:
    """classify_category / _reason / _keywords; a failed call gives three empty texts.

    ``shape_ok`` is false where the response has a list in single mode or a text
    in multi mode; the value is kept either way.
    """
    v = F.col("_answer")
    ok = F.col("response_ok")
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.category", "variant")).startswith("ARRAY<")
    return (
        df.withColumn("_answer", parsed(F.col(response)))
        .withColumn("response_ok", is_answer(v))
        .withColumns(
            {
                "classify_category": F.coalesce(F.when(ok, text_at(v, "$.category")), F.lit("")),
                "classify_reason": F.coalesce(F.when(ok, text_at(v, "$.reason")), F.lit("")),
                "classify_keywords": F.coalesce(F.when(ok, text_at(v, "$.keywords")), F.lit("")),
                "shape_ok": F.coalesce(is_list, F.lit(False)) == F.lit(mode == "multi"),
            }
        )
        .drop("_answer", response)
    )


def dimension_values(df: DataFrame, response: str = "response") -> DataFrame:
    """One row per dimension of each answered response: ``dim`` and its raw ``value``."""
    answers = df.withColumn("_answer", parsed(F.col(response))).where(is_answer(F.col("_answer")))
    fields = df.sparkSession.tvf.variant_explode(F.col("_answer").outer())
    return (
        answers.lateralJoin(fields)
        .withColumnsRenamed({"key": "dim"})
        .drop("_answer", response, "pos")
    )


def label_fields(value: Column) -> dict[str, Column]:
    """category and reason of one dimension; missing or null gives the empty text."""
    return {
        "category": F.coalesce(text_at(value, "$.category"), F.lit("")),
        "reason": F.coalesce(text_at(value, "$.reason"), F.lit("")),
    }


#: ``extra`` holds the other fields of a category as the members of a JSON object, or null.
CATEGORY_TYPE = "struct<name:string,definition:string,judgment_suggestions:string,keywords:array<string>,extra:string>"
CATEGORY_FIELDS = ["name", "definition", "judgment_suggestions", "keywords"]


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def other_members(document: Column, known: list[str]) -> Column:
    """The members of a JSON object apart from ``known`` as JSON text, in their order; null where there are none.

    Objects and lists inside keep the order of their keys, numbers may be written in another way.
    """
    kinds = F.transform_values(F.from_json(document, "map<string,variant>"), lambda _, x: F.schema_of_variant(x))

    def member(e: Column) -> Column:
        value = F.when(kinds[e["key"]] == "STRING", json_text(e["value"])).otherwise(F.coalesce(e["value"], F.lit("null")))
        return F.concat(json_text(e["key"]), F.lit(":"), value)

    others = F.filter(F.map_entries(F.from_json(document, "map<string,string>")), lambda e: ~e["key"].isin(known))
    return F.when(F.size(others) > 0, F.array_join(F.transform(others, member), ","))


def category_json(category: Column) -> Column:
    """A category as a JSON object, its other members behind the known ones."""
    known = F.to_json(F.struct(*[category[f].alias(f) for f in CATEGORY_FIELDS]))
    return with_members(known, category["extra"])


def with_members(document: Column, members: Column) -> Column:
    """A JSON object with further members; ``members`` may be null."""
    comma = F.when(document == "{}", F.lit("")).otherwise(F.lit(","))
    longer = F.concat(F.substring(document, F.lit(1), F.length(document) - 1), comma, members, F.lit("}"))
    return F.when(members.isNull(), document).otherwise(longer)


def refined_categories(response: Column) -> Column:
    """The category list of a convergence answer with all fields of each; a missing key gives an empty list."""
    items = F.from_json(response, "refined_categories array<string>")["refined_categories"]

    def category(item: Column) -> Column:
        c = F.try_parse_json(item)
        return F.struct(
            F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("")).alias("name"),
            text_at(c, "$.definition").alias("definition"),
            text_at(c, "$.judgment_suggestions").alias("judgment_suggestions"),
            list_at(c, "$.keywords").alias("keywords"),
            other_members(item, CATEGORY_FIELDS).alias("extra"),
        )

    return F.coalesce(F.transform(items, category), F.from_json(F.lit("[]"), f"array<{CATEGORY_TYPE}>"))


def label_mapping(value: Column) -> Column:
    """The label mapping of a convergence answer; a missing key gives an empty map."""
    return F.coalesce(
        F.try_variant_get(value, "$.mapping", "map<string,string>"),
        F.from_json(F.lit("{}"), "map<string,string>"),
    )
