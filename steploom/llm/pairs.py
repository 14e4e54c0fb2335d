"""Defects of answers to prompts, by ordered rules on the text.

Every rule is a column expression, so a pass over the pairs is one scan without a shuffle. A rule
looks at the answer's prose: tags removed, and for the language also quotations, searches and
retrieved documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.endings import unfinished
from steploom.llm.language import LANGUAGES, best_language, foreign_letters, function_words, language_scores
from steploom.llm.profiles import DIFFERENT, UNCLEAR, Profiles

# Order of precedence where one type is wanted.
DEFECTS = ("empty", "copies_prompt", "refusal", "truncated", "other_language")

# Phrases in which a writer declines in the first person. Third persons who refuse,
# and searches that find nothing, don't match.
REFUSALS = (
    # en
    r"\bas an? (?:ai|artificial intelligence|language model)\b",
    r"\bi(?: am|['’]m) (?:not able|unable|not allowed|not permitted) to (?:answer|help|assist|respond|discuss|provide|comply|share|do that|give)",
    r"\bi (?:cannot|can['’]?t|can not|could not|will not|won['’]?t) (?:be able to )?(?:assist|help|answer|provide|comply|discuss|respond|fulfil|share|give|talk|do that)",
    r"\bi (?:must|have to|need to) (?:decline|refuse)", r"\bnot possible for me to\b", r"\bagainst my (?:guidelines|rules|policy|policies|principles)\b",
    # es
    r"\bno (?:me es posible|puedo|podré|me está permitido) (?:responder|ayudar|contestar|proporcionar|dar|hablar|asistir|ofrecer|comentar|atender)", r"\b(?:debo|tengo que) (?:negarme|declinar|rechazar|abstenerme)", r"\bcontra mis (?:normas|reglas|directrices|principios)\b", r"\bcomo (?:una? )?(?:sistema de ia|ia|inteligencia artificial|modelo de lenguaje)\b", r"\bme es imposible (?:responder|ayudar|contestar|dar)",
    # fr
    r"\bje ne (?:peux|suis|puis|pourrai|saurais)(?: malheureusement)? pas (?:en mesure |autoris[ée]e? |capable )?(?:d['’e] ?)?(?:aider|répondre|vous aider|y répondre|fournir|donner|discuter|traiter|parler|accéder)", r"\bil m['’]est impossible\b", r"\bje (?:dois|me vois contraint de|suis obligé de) (?:refuser|décliner)", r"\benfrein\w+ mes (?:règles|directives|principes)\b", r"\ben tant qu['’](?:ia|intelligence artificielle|assistant|modèle|système d['’]ia)", r"\bcontre mes (?:règles|directives|principes)\b",
    # de
    r"\bich (?:kann|darf|werde|könnte) (?:\w+ ){0,5}?(?:nicht|keine?) (?:\w+ ){0,3}?(?:helfen|beantworten|antworten|antwort|auskunft|geben|unterstützen|besprechen|weiterhelfen)", r"\bmuss ich? ?(?:\w+ ){0,3}?(?:ablehnen|verweigern)", r"\bich muss (?:\w+ ){0,4}?(?:ablehnen|verweigern)", r"\b(?:es )?ist mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)", r"\bals (?:ki|künstliche intelligenz|sprachmodell)\b", r"\bgegen meine (?:richtlinien|regeln|grundsätze|vorgaben)\b",
    # it, pt, ru, zh
    r"\bnon (?:posso|sono in grado di|mi è possibile) (?:aiutar|risponder|fornir|discuter|assister)\w*", r"\bnão (?:posso|consigo|me é possível) (?:ajudar|responder|fornecer|discutir)", r"я не (?:могу|в состоянии) (?:ответить|помочь|обсуждать|предоставить)", r"(?:我)?(?:无法|不能|没有办法)(?:回答|帮助|提供|协助|讨论)", r"作为(?:一个)?(?:人工智能|ai)",
)
# their common word boundary stands in front once, which spares trying them inside words
_REFUSAL = r"\b(?:" + "|".join(r[2:] for r in REFUSALS if r.startswith(r"\b")) + ")|" + "|".join(r for r in REFUSALS if not r.startswith(r"\b"))
_TAG = r"</?(?:think|search|answer|documents)>"


def question_of_prompt(prompt: Column) -> Column:
    """The question inside a chat template, a "Question: ... Answer:" form, or the bare prompt."""
    user = F.regexp_extract(prompt, r"(?s)<\|im_start\|>user\n(.*?)(?:<\|im_end\|>|$)", 1)
    inner = F.when(prompt.contains("<|im_start|>"), user).otherwise(prompt)
    inner = F.regexp_replace(inner, r"(?s)\n\s*Answer:\s*$", "")
    return F.trim(F.regexp_replace(inner, r"^\s*Question:\s*", ""))


def _bare(text: Column) -> Column:
    """Letters and digits only, in one case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def with_defects(rows: DataFrame, prompt: str, answer: str, out: str, profiles: Profiles | None = None) -> DataFrame:
    """``rows`` with an array of every defect the answer shows, in the order of DEFECTS.

    A null answer is empty. With a null or wordless prompt no rule that needs the question fires.
    The steps are columns of their own, so that none is worked out twice. With ``profiles`` the languages
    that have one are told by it, and scripts and function words only speak for other languages.
    """
    kept = rows.columns
    text, question, body = F.col("__text"), F.col("__question"), F.col("__body")
    rows = rows.withColumn("__text", F.coalesce(answer, F.lit(""))).withColumn("__question", question_of_prompt(F.coalesce(prompt, F.lit(""))))
    rows = rows.withColumn("__body", F.regexp_replace(text, _TAG, " "))
    prose = F.regexp_replace(text, r"(?s)<search>.*?(?:</search>|$)|<documents>.*?(?:</documents>|$)", " ")
    prose = F.regexp_replace(F.regexp_replace(prose, _TAG, " "), r"(?s)[\"“„«][^\"”“»]*(?:[\"”“»]|$)", " ")
    rows = rows.withColumn("__prose", prose)
    if profiles is not None:
        rows = _with_profiles(rows.select(*kept, "__text", "__question", "__body", "__prose"), profiles)
    rows = rows.withColumn("__content", _bare(body)).withColumn("__asked", _bare(question))
    rows = rows.withColumn("__prose_words", function_words(F.col("__prose"))).withColumn("__question_words", function_words(question))
    rows = rows.withColumn("__prose_foreign", foreign_letters(F.col("__prose"))).withColumn("__question_foreign", foreign_letters(question))
    rows = rows.withColumn("__told", language_scores(F.col("__prose_words"), F.col("__prose_foreign"))).withColumn("__lang", language_scores(F.col("__question_words"), F.col("__question_foreign")))
    content, asked = F.col("__content"), F.col("__asked")
    # a last answer tag that is closed around nothing, whatever was thought before it
    hollow = text.rlike(r"(?s)<answer>[^\p{L}\p{N}]*</answer>\s*$")
    rows = rows.withColumn("__said", F.regexp_replace(content, r"^(?:question|answer)", ""))
    said = F.col("__said")
    rest = F.regexp_replace(F.replace(said, asked, F.lit("")), r"^(?:question|answer)+$", "")
    prefix = asked.startswith(said) & (F.length(said) * 10 >= F.length(asked) * 8)
    asked_in, told_in = best_language(F.col("__lang")), best_language(F.col("__told"), 2)
    own = F.get(F.col("__told"), asked_in - 1)
    foreign = (told_in != asked_in) & (F.array_max("__told") > 2 * own)
    if profiles is not None:
        profiled = [k for k, name in enumerate(LANGUAGES, 1) if name in profiles.languages]
        # where profiles leave it open, the words decide for all languages
        foreign = (F.col("__compared") == DIFFERENT) | (foreign & ((F.col("__compared") == UNCLEAR) | ~told_in.isin(*profiled)))
    found = {
        "empty": (content == "") | hollow,
        "copies_prompt": (asked != "") & (content != "") & ((rest == "") | prefix),
        "refusal": F.lower(body).rlike(_REFUSAL),
        "truncated": unfinished(text),
        "other_language": foreign,
    }
    return rows.select(*kept, F.filter(F.array(*(F.when(found[d], F.lit(d)) for d in DEFECTS)), lambda d: d.isNotNull()).alias(out))


def _with_profiles(rows: DataFrame, profiles: Profiles) -> DataFrame:
    """``rows`` with ``__compared``: what the profiles say of the languages of prose and question."""
    question, prose = rows.columns.index("__question"), rows.columns.index("__prose")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = profiles.compare(batch.column(question).to_pylist(), batch.column(prose).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told.astype(np.int32))], [*batch.schema.names, "__compared"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `__compared` int")


def only_defect(types: Column) -> Column:
    """The one defect to report: a refusal before the empty answer tag it leaves, else the first."""
    return F.when(F.array_contains(types, "refusal") & ~F.array_contains(types, "copies_prompt"), F.lit("refusal")).otherwise(F.get(types, F.lit(0)))


def broken_sides(df: DataFrame, record: str, prompt: str, sides: list[str], profiles: Profiles | None = None) -> DataFrame:
    """(record, side, defect, defects) of every defective side.

    Repeated rows count each; a row with a null ``record`` keeps it null. Columns besides
    ``record``, ``prompt`` and ``sides`` are not read.
    """
    long = df.select(
        F.col(f"`{record}`").alias(record), F.col(f"`{prompt}`").cast("string").alias("__prompt"),
        F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"`{s}`").cast("string").alias("answer")) for s in sides))).alias("__s"),
    )
    long = long.select(record, F.col("__s.side").alias("side"), "__prompt", F.col("__s.answer").alias("__answer"))
    typed = with_defects(long, "__prompt", "__answer", "defects", profiles)
    # a generator and no filter: a filter on the result would be pushed below the steps and repeat them all
    one = F.struct(only_defect(F.col("defects")).alias("defect"), "defects")
    broken = typed.select(record, "side", F.explode(F.filter(F.array(one), lambda x: F.size(x["defects"]) > 0)).alias("__d"))
    return broken.select(record, "side", "__d.defect", "__d.defects")
