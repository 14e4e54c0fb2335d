import pytest
from pyspark.sql import functions as F

from steploom.functions import answers, formatting, parse, text
from steploom.operators import labeling, masks, voting


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return df.select(column.alias("x")).first().x


def one(spark, function, *args):
    df = spark.createDataFrame([args], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(function(*(F.col(f"a{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize(("function", "want"), [(text.normal_full, "u s"), (text.normal_joined, "the usking"), (text.normal_bare, "usking"), (text.normal_ascii, "the u s king")])
def test_normalisers_differ(spark, function, want):
    assert one(spark, function, "The U.S._King") == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip, "  \tx y \n") == "x y"


@pytest.mark.parametrize(("check", "p", "g", "want"), [
    (answers.cover_tokens, "Victor John Mature was an actor", "Victor Mature", True), (answers.cover_tokens, "alcohol content of beer", "ingredients in beer", False), (answers.cover_tokens, "anything", "", True),
    (answers.cover_tokens, "yes it is", "yes", True), (answers.cover_tokens, "it is yes", "yes", False), (answers.cover_phrase, "Victor Mature was born first", "Victor Mature", True), (answers.cover_phrase, "Victor John Mature", "Victor Mature", False),
    (answers.match_either, "Orlo", "orlo bay", True), (answers.match_either, "", "orlo", False), (answers.match_unquoted, '"Or"lo', "orlo", True), (answers.match_contains, "in Orlo bay", "Orlo", True), (answers.exact_match, "True", "yes", True),
])
def test_answer_checks(spark, check, p, g, want):
    assert one(spark, check, p, g) is want


def test_f1_forms(spark):
    assert one(spark, answers.f1_full, "True", "yes").f1 == 1.0
    assert one(spark, answers.f1_reward, "True", "yes") == 0.0
    assert one(spark, answers.f1_board, "True", "yes") == 0.0
    assert one(spark, answers.f1_full, "no", "yes no").f1 == 0.0
    assert one(spark, answers.f1_board, "a b b c", "b b d") == pytest.approx(2 / 3)


@pytest.mark.parametrize(("t", "want"), [
    ("<think>x</think><answer> (Foo Bar) </answer>", "Foo Bar"), ("<answer>Foo Bar.</answer>", "Foo Bar"), ('Action: Finish[answer="Foo"]', "Foo"), ("Final Answer: Foo Bar because it is so", "Foo Bar"), ("Therefore, the answer is Foo Bar. Next", "Foo Bar. Next"),
    ("We know that the answer is 42; done", "42"), ("It was long ago (in Orlo).", "in Orlo"), ("Intermediate answer: x\nOrlo\nBay", "Orlo"), ("", ""), (None, ""), ("<answer>..</answer>\nfinal answer: Z", "Z"),
])
def test_answer_extraction_level_by_level(spark, t, want):
    assert one(spark, answers.extract_answer, t) == want


def test_sections_and_actions(spark):
    t = "<think>a</think>\n<search>q</search>\n<answer>b</answer>"
    assert one(spark, lambda c: parse.tagged_action(c, "search"), t).action == "search"
    assert one(spark, lambda c: parse.tagged_action(c, "answer"), t).input == "b"
    assert one(spark, parse.action_of, 'x Action: Search[query="who"]').input == "who"
    assert one(spark, parse.action_of, "so the answer is 3") == ("finish", None)
    assert one(spark, parse.action_of, "nothing") == (None, None)
    assert one(spark, parse.sections_open, "a</think><answer>b").asDict() == {"think": "a", "search": "", "answer": "b"}
    assert one(spark, lambda c: parse.section(c, "search"), "no tags") is None


def test_numbered_steps(spark):
    got = one(spark, parse.numbered_steps, "Step 1: a\nmore\nStep 2: b")
    assert [(s.number, s.content) for s in got] == [(1, "a\nmore"), (2, "b")]
    assert [(s.number, s.content) for s in one(spark, parse.numbered_steps, "plain")] == [(1, "plain")]
    assert one(spark, parse.numbered_steps, " ") == []
    assert one(spark, lambda c: parse.own_step(c, F.lit(2)), "Step 2: b\n\nStep 3: c") == "b"
    assert one(spark, parse.forced_answer, "Step 1: x. Final Answer: Foo") == "foo"


def test_judge_json(spark):
    fenced, bare = '```json\n[{"step":1,"label":"GOOD","reasoning":"r"},]\n```', '[{"step":1,"label":"GOOD"},]'
    got = [(x.label, x.reasoning) for x in one(spark, lambda c: parse.judge_labels(c, F.lit(2)), fenced)]
    assert got == [("GOOD", "r"), ("BAD", "Failed to parse response")]
    assert [x.label for x in one(spark, lambda c: parse.judge_labels(c, F.lit(2)), bare)] == ["BAD", "BAD"]
    assert one(spark, lambda c: parse.judge_labels(c, F.lit(0)), fenced) == []


def test_critic_output(spark):
    assert one(spark, lambda c: parse.critic_output(c, strict=False), "BAD, see 1").score == 1
    assert one(spark, parse.critic_output, "BAD, see 1").score == 0
    assert one(spark, parse.critic_output, "[REASONING] r [/REASONING]\nLabel: 1").asDict() == {"score": 1, "reasoning": "r"}
    assert one(spark, parse.critic_label, "no verdict") == -1


@pytest.mark.parametrize(("before", "after", "want"), [(0.0, 0.0, "BAD"), (0.0, 0.2, "GOOD"), (0.8, 0.2, "BAD"), (0.4, 0.4, "GOOD")])
def test_rpe(spark, before, after, want):
    assert value(spark, labeling.rpe_label(F.lit(before), F.lit(after))) == want


def test_step_scores_of_nothing_are_zero(spark):
    empty = F.array().cast("array<double>")
    assert [value(spark, voting.step_score(empty, m)) for m in ("min", "product", "avg")] == [0.0] * 3


def test_step_text_and_observation(spark):
    cols = [F.lit(x) for x in ("t", "q", "a", "d")]
    assert value(spark, formatting.step_text(*cols)) == "<think>t</think>\n<search>q</search>\n<documents>\nd\n</documents>"
    assert value(spark, formatting.step_text(*cols, exclusive=False, documents_last=False)).endswith("</documents>\n<answer>a</answer>")
    p = F.array(F.struct(F.lit("T").alias("title"), F.lit("x" * 600).alias("text")))
    assert value(spark, formatting.observation(p)) == "<documents>\n[1] T: " + "x" * 500 + "...\n</documents>"
    assert value(spark, formatting.split_contents(F.lit("T\nbody\nmore"))).asDict() == {"title": "T", "text": "body\nmore"}


def test_masks(spark):
    t = "<think>a</think>\n<documents>\nx y\n</documents>\n<think>b"
    docs = one(spark, masks.document_spans, t)
    assert [t[s.start : s.end] for s in docs] == ["<documents>\nx y\n</documents>"]
    second = t.rindex("<think>")
    assert [t[s.start : s.end] for s in one(spark, masks.step_spans, t)] == [t[:second], t[second:]]
    assert [t[s.start : s.end] for s in one(spark, masks.word_spans, t)] == t.split()
    state = F.split(F.lit("a < documents > x </ documents > b"), " ")
    got = value(spark, masks.masked_by_state(state, ["<", "documents", ">"], ["</", "documents", ">"]))
    assert got == [False, False, False, True, True, True, True, True, False]
    open_end = masks.masked_by_state(F.split(F.lit("a < documents > x"), " "), ["<", "documents", ">"], ["</", "documents", ">"])
    assert value(spark, open_end) == [False, False, False, True, True]
    assert value(spark, masks.last_marker(F.lit("a|b|c"), "|")) == 3 and value(spark, masks.last_marker(F.lit("abc"), "|")) == -1
    assert value(spark, masks.padded(F.array(F.lit(1)), F.lit(3))) == [1, -100, -100]
