"""Model output into columns: tagged sections, actions, numbered steps, judge and critic output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import strip

SECTIONS = ("think", "search", "answer", "documents")
JUDGEMENTS = T.ArrayType(T.StructType([T.StructField("step", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("reasoning", T.StringType())]))


def section(text: Column, tag: str) -> Column:
    """The stripped inside of the first ``tag``, null when the text has none."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def sections(text: Column) -> Column:
    """struct(think, search, answer, documents), each null where absent."""
    return F.struct(*(section(text, t).alias(t) for t in SECTIONS))


def section_open(text: Column, tag: str) -> Column:
    """As :func:`section`, but an unclosed tag reaches to the end; '' when there is none."""
    return strip(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)(?:</{tag}>|\z)", 1))


def sections_open(generated: Column) -> Column:
    """struct(think, search, answer) of output that was stopped early and begins inside its thought.

    An answer excludes a search.
    """
    text = F.concat(F.lit("<think>"), generated)
    answer = section_open(text, "answer")
    return F.struct(section_open(text, "think").alias("think"), F.when(answer == "", section_open(text, "search")).otherwise("").alias("search"), answer.alias("answer"))


def tagged_action(text: Column, prefer: str) -> Column:
    """struct(action, input) of tagged text; ``prefer`` names the section that wins if both are there."""
    first, second = ("search", "answer") if prefer == "search" else ("answer", "search")
    a, b = section(text, first), section(text, second)
    names = {"search": "search", "answer": "finish"}
    return F.struct(F.when(a.isNotNull(), names[first]).when(b.isNotNull(), names[second]).alias("action"), F.coalesce(a, b).alias("input"))


def _pick(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def action_of(text: Column, reasons: bool = True) -> Column:
    """struct(action, input) by a cascade: answer and search tags, legacy Finish, Search and Reason
    actions, a thought, and phrases that announce a final answer (finish without input)."""
    rules = [
        ("finish", r"(?is)<answer>(.+?)</answer>"), ("search", r"(?is)<search>(.+?)</search>"),
        ("finish", r"(?is)Action:\s*Finish\[answer\s*=\s*[\"']?(.+?)[\"']?\]"), ("search", r"(?is)Action:\s*Search\[query\s*=\s*[\"']?(.+?)[\"']?\]"),
    ]
    if reasons:
        rules.append(("reason", r"(?is)Action:\s*Reason\[content\s*=\s*[\"']?(.+?)[\"']?\]"))
    rules.append(("reason", r"(?is)<think>(.+?)</think>"))
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    low = F.lower(text)
    kind = F.when(low.contains("final answer:") | low.contains("the answer is") | low.contains("therefore, the answer"), "finish")
    for name, pattern in reversed(rules):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
        value = F.coalesce(_pick(text, pattern), value)
    return F.struct(kind.alias("action"), value.alias("input"))


def own_step(response: Column, number: Column) -> Column:
    """A response cut before the next numbered step, without its own "Step k:"."""
    cut = F.regexp_replace(response, r"(?s)\n+Step\s+\d+:.*$", "")
    return strip(F.regexp_replace(strip(cut), F.concat(F.lit(r"^Step\s+"), number.cast("string"), F.lit(r":\s*")), F.lit("")))


def numbered_steps(text: Column) -> Column:
    """array<struct(number, content)> of "Step k:" sections; the whole text as step 1 if there is none."""
    pattern = r"(?ms)^\s*Step\s+(\d+):\s*(.*?)(?=^\s*Step\s+\d+:|\z)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("c"))
    steps = F.transform(found, lambda x: F.struct(x["n"].cast("int").alias("number"), strip(x["c"]).alias("content")))
    whole = F.array(F.struct(F.lit(1).alias("number"), strip(text).alias("content")))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.slice(whole, 1, 0)).when(F.size(steps) > 0, steps).otherwise(whole)


def forced_answer(text: Column) -> Column:
    """Final answer of step-forced text, in lower case; the last sentence if no phrase announces one."""
    low = F.lower(text)
    phrases = (r"(?s)final answer\s*:?\s*([^\n.]+)", r"(?s)the answer is\s*:?\s*([^\n.]+)", r"(?s)therefore,?\s*([^\n.]+)")
    last = F.element_at(F.filter(F.transform(F.split(low, r"\."), strip), lambda s: s != ""), -1)
    sentences = F.filter(F.transform(F.split(low, r"\."), strip), lambda s: s != "")
    return F.coalesce(*(F.nullif(strip(F.regexp_extract(low, p, 1)), F.lit("")) for p in phrases), F.when(F.size(sentences) > 0, last), F.lit(""))


def trajectory_answer(last_step: Column) -> Column:
    """Final answer in a trajectory's last step: tag, Finish action, then two phrases to the line's end."""
    rules = (r"(?is)<answer>(.+?)</answer>", r"(?is)Finish\[answer\s*=\s*[\"']?(.+?)[\"']?\]", r"(?i)final answer:\s*(.+)", r"(?i)the answer is\s*:?\s*(.+)")
    return F.coalesce(*(F.nullif(strip(F.regexp_extract(last_step, r, 1)), F.lit("")) for r in rules), F.lit(""))


def judge_array(response: Column) -> Column:
    """The judgements in a response as an array, null where none can be read.

    A fenced array may need its trailing commas removed; a bare one must end in an object.
    """
    fenced = F.nullif(F.regexp_extract(response, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(response, r"(?s)(\[\s*\{.*\}\s*\])", 1), F.lit(""))
    found = F.coalesce(fenced, bare)
    repaired = F.regexp_replace(found, r",\s*([\]}])", "$1")
    return F.coalesce(F.from_json(found, JUDGEMENTS), F.from_json(repaired, JUDGEMENTS))


def judge_labels(response: Column, n_steps: Column) -> Column:
    """array<struct(step, label, reasoning)> for steps 1 to n: GOOD or BAD, missing ones BAD."""
    found = judge_array(response)
    expected = F.when(n_steps > 0, F.sequence(F.lit(1), n_steps)).otherwise(F.array().cast("array<int>"))

    def judged(i: Column) -> Column:
        row = F.get(F.filter(found, lambda x: x["step"] == i), F.lit(0))
        good = F.upper(strip(row["label"])) == "GOOD"
        return F.struct(i.alias("step"), F.when(good, "GOOD").otherwise("BAD").alias("label"), F.when(row.isNull(), "Failed to parse response").otherwise(F.coalesce(row["reasoning"], F.lit(""))).alias("reasoning"))

    return F.transform(expected, judged)


def critic_output(text: Column, strict: bool = True) -> Column:
    """struct(score, reasoning). Strict reads "Label: 1"; otherwise any 1 in the text counts."""
    inner = F.regexp_extract(text, r"(?s)\[REASONING\](.*?)(?:\[/REASONING\]|\z)", 1)
    reasoning = F.when(text.contains("[REASONING]"), strip(inner)).otherwise(strip(text))
    score = text.rlike(r"Label:\s*1") if strict else text.contains("1")
    return F.struct(score.cast("int").alias("score"), reasoning.alias("reasoning"))


def critic_label(text: Column) -> Column:
    """1, 0, or -1 where the output names neither."""
    plain = strip(text)
    return F.when(plain.contains("Label: 1") | plain.contains("Label:1") | plain.endswith("1"), 1).when(plain.contains("Label: 0") | plain.contains("Label:0") | plain.endswith("0"), 0).otherwise(-1)


def soft_score(log_one: Column, log_zero: Column, label: Column) -> Column:
    """Probability of 1 from the log-probabilities of both label tokens; the label where both lack."""
    one, zero = F.exp(log_one), F.exp(log_zero)
    both = one / (one + zero)
    known = F.when(log_one.isNotNull() & log_zero.isNotNull(), both).when(log_one.isNotNull(), 1 - 1e-6).when(log_zero.isNotNull(), 1e-6)
    return F.coalesce(known, F.when(label == 1, 1.0).when(label == 0, 0.0).otherwise(0.5))


def positive_softmax(logit_zero: Column, logit_one: Column) -> Column:
    """Softmax probability of the positive class of two logits."""
    return 1 / (1 + F.exp(logit_zero - logit_one))


def label_value(label: Column) -> Column:
    """1 for good, 0 for bad, null otherwise."""
    word = F.lower(strip(label))
    return F.when(word.isin("good", "1"), 1).when(word.isin("bad", "0"), 0)
