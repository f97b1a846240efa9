"""Prompt rendering and the default templates (own wording)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def render(template: str, **values: object) -> Column:
    """Replace ``{{name}}`` by its value, one name after the other.

    Replacement is sequential, so a value that holds a later ``{{name}}`` is
    expanded too; names the template lacks are ignored and placeholders nobody
    fills stay.  Plain values are filled in before the job starts for as long
    as no column has been met, so the executors only replace what varies by row.
    """
    text: str | Column = template
    for name, value in values.items():
        mark = "{{" + name + "}}"
        if isinstance(text, str) and not isinstance(value, Column):
            text = text.replace(mark, str(value))
            continue
        if isinstance(text, str):
            if mark not in text:
                continue
            text = F.lit(text)
        filled = value.cast("string") if isinstance(value, Column) else F.lit(str(value))
        text = F.replace(text, F.lit(mark), filled)
    return F.lit(text) if isinstance(text, str) else text


def read_template(spark: SparkSession, path: str) -> str:
    """A template of the user's own, from any file system Spark reads."""
    return spark.read.text(path, wholetext=True).head().value


NO_GUIDE = "No particular guidance."

CRITERIA = """You prepare a literature screening on this topic: {{topic}}

Below are {{sample_count}} papers drawn from the collection.

{{samples_text}}

Describe the sample, name the subtopics you see and lay down what each score from
5 (central to the topic) to 1 (off topic) means for this collection.
Write in {{output_lang}} and answer with one JSON object:
{"analysis": "...", "subtopics": ["..."],
 "criteria": {"5": "...", "4": "...", "3": "...", "2": "...", "1": "..."},
 "positives": ["#n: why"], "negatives": ["#n: why"], "boundary": "..."}
"""

SCORE = """Rate how relevant one paper is to a topic.

Topic: {{topic}}
Meaning of the scores: {{criteria}}

{{paper_text}}

Give an integer from 1 to 5, a short reason drawn from the paper and the terms that
support it. Write the reason in {{output_lang}} and answer with one JSON object:
{"score": 3, "reason": "...", "keywords": ["..."]}
"""

EXPLORE = """Name the category of one paper along each dimension of analysis.

{{dimensions_desc}}

Guidance: {{researcher_guide}}

{{paper_text}}

Use short, precise terms and give evidence from the abstract. Write in
{{output_lang}} and answer with one JSON object keyed by dimension:
{"dimension": {"category": "...", "reason": "..."}}
"""

CONVERGE = """Merge labels of the dimension "{{dim_name}}" into few distinct, specific categories.

New labels with their number of papers:
{{new_labels}}

Categories so far:
{{existing_taxonomy}}

Keep at most {{limit_cats}} categories, give no vague names, and map every new label
and every category so far to one of the new names.
Guidance: {{researcher_guide}}
Write in {{output_lang}} and answer with one JSON object:
{"refined_categories": [{"name": "...", "definition": "...",
  "judgment_suggestions": "...", "keywords": ["..."]}],
 "mapping": {"label or earlier category": "new name"}}
"""

CLASSIFY = """File one paper under the categories given.

Categories:
{{schema_text}}

Mode: {{classify_mode}} (single = exactly one category or an empty text, multi = a list
of all that fit). Use the names exactly as given and rely on evidence in the paper.

{{paper_text}}

Guidance: {{researcher_guide}}
Write in {{output_lang}} and answer with one JSON object:
{"category": "..." or ["..."], "reason": "...", "keywords": ["..."]}
"""

TRANSLATE_TEXT = """Target language: {{target_lang}}
Render the passage below in it. Terms of the trade have to come out as specialists write them. Send back nothing but the result.

{{text}}"""

TRANSLATE_LIST = """Target language: {{target_lang}}
Every entry of the JSON list below is to be rendered in it. Terms of the trade have to come out as specialists write them. Reply with a JSON object: its keys are the entries as they stand, its values what they become.

{{texts}}"""

FREE_DIMENSIONS = "Which aspects to label is up to you; name the ones that tell these papers apart."
GIVEN_DIMENSIONS = "Label each of these aspects:\n"

DEFAULT_CRITERIA = (
    '{"5":"central to the topic","4":"clearly related","3":"partly related",'
    '"2":"loosely related","1":"unrelated"}'
)


def dimensions_text(dims: list[str]) -> str:
    if not dims:
        return FREE_DIMENSIONS
    return GIVEN_DIMENSIONS + "\n".join(f"- {d}" for d in dims)
