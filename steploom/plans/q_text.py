"""Queries over the text functions: normalisers, answer metrics, parsing, formatting, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.functions import answers, formatting, parse, text
from steploom.operators import masks
from steploom.plans import views
from steploom.sources import read_table

_ANSWERS_SQL = "select distinct trajectory_id, gold_answer, final_answer, question from trajectories"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "trajectories").select("trajectory_id", "gold_answer", "final_answer", "question").distinct()


def _normalise(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _answers(spark, sf_dir).select("trajectory_id", function(F.col("question")).alias("question"), function(F.col("gold_answer")).alias("gold"), function(F.col("final_answer")).alias("final"))

    return run


def _normalise_sql(expr) -> str:
    return f"select trajectory_id, {expr('question')} as question, {expr('gold_answer')} as gold, {expr('final_answer')} as final from ({_ANSWERS_SQL})"


def answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three token F1 forms of every scored prediction."""
    v = views.votes(spark, sf_dir)
    p, g = F.col("answer"), F.col("gold")
    a = answers.f1_full(p, g)
    return v.where("answer is not null and gold is not null").select(
        "trajectory_id", F.round(a["f1"], 6).alias("f1_full"), F.round(a["precision"], 6).alias("precision"), F.round(a["recall"], 6).alias("recall"),
        F.round(answers.f1_reward(p, g), 6).alias("f1_reward"), F.round(answers.f1_board(p, g), 6).alias("f1_board"),
    )


def _f1_columns(name: str, norm, guard: bool, mapped: bool) -> tuple[str, str, str]:
    """(normalised columns, token columns, same count) of one F1 form."""
    m = (lambda x: f"case {x} when 'True' then 'yes' when 'False' then 'no' else {x} end") if mapped else (lambda x: x)
    n = f"{norm(m('answer'))} as p{name}, {norm(m('gold'))} as g{name}"
    t = f"{views.sql_tokens('p' + name)} as pt{name}, {views.sql_tokens('g' + name)} as gt{name}"
    same = views.sql_same("pt" + name, "gt" + name)
    words = "('yes', 'no', 'noanswer')"
    cut = f"case when (p{name} in {words} or g{name} in {words}) and p{name} <> g{name} then 0 else {same} end" if guard else same
    return n, t, f"{cut} as s{name}"


def _f1_sql() -> str:
    forms = [_f1_columns("a", views.sql_full, True, True), _f1_columns("b", views.sql_joined, True, False), _f1_columns("c", views.sql_bare, False, False)]
    n, t, s = (", ".join(f[i] for f in forms) for i in range(3))

    def f1(x: str) -> str:
        return f"case when s{x} = 0 then 0.0 else round(2.0 * (s{x} / len(pt{x})) * (s{x} / len(gt{x})) / (s{x} / len(pt{x}) + s{x} / len(gt{x})), 6) end"

    return f"""with {views.VOTES_SQL},
n as (select trajectory_id, {n} from votes where answer is not null and gold is not null), t as (select *, {t} from n), s as (select *, {s} from t)
select trajectory_id, {f1('a')} as f1_full, case when sa = 0 then 0.0 else round(sa / len(pta), 6) end as precision, case when sa = 0 then 0.0 else round(sa / len(gta), 6) end as recall,
  {f1('b')} as f1_reward, {f1('c')} as f1_board from s"""


def answer_em_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and the cover and containment checks of every scored prediction."""
    v = views.votes(spark, sf_dir).where("answer is not null and gold is not null")
    p, g = F.col("answer"), F.col("gold")
    checks = {"em": answers.exact_match, "cover_tokens": answers.cover_tokens, "cover_phrase": answers.cover_phrase, "either": answers.match_either, "unquoted": answers.match_unquoted, "contains": answers.match_contains}
    return v.select("trajectory_id", *(c(p, g).cast("int").alias(n) for n, c in checks.items()))


_EM_SQL = f"""with {views.VOTES_SQL},
n as (select trajectory_id, lower(trim(answer)) as p2, lower(trim(gold)) as g2,
  {views.sql_full("case answer when 'True' then 'yes' when 'False' then 'no' else answer end")} as p, {views.sql_full("case gold when 'True' then 'yes' when 'False' then 'no' else gold end")} as g
  from votes where answer is not null and gold is not null),
t as (select *, {views.sql_tokens('p')} as pt, {views.sql_tokens('g')} as gt, trim(translate(p2, '"''“”', '')) as p3, trim(translate(g2, '"''“”', '')) as g3 from n)
select trajectory_id, cast(p = g as integer) as em,
  cast(case when g in ('yes', 'no', 'noanswer') then coalesce(pt[1] = g, false) else len(list_filter(gt, lambda x: not list_contains(pt, x))) = 0 end as integer) as cover_tokens,
  cast(case when g in ('yes', 'no', 'noanswer') or p in ('yes', 'no', 'noanswer') then p = g else contains(p, g) end as integer) as cover_phrase,
  cast(p2 <> '' and g2 <> '' and (contains(p2, g2) or contains(g2, p2)) as integer) as either,
  cast((p2 <> '' and g2 <> '' and (contains(p2, g2) or contains(g2, p2))) or (p3 <> '' and g3 <> '' and (contains(p3, g3) or contains(g3, p3))) as integer) as unquoted,
  cast(contains(p2, g2) as integer) as contains from t"""


def metrics_multi_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each trajectory's answer against its gold answer and supporting facts."""
    t = read_table(spark, sf_dir, "trajectories").select("trajectory_id", "final_answer", "gold_answer", "supporting_facts").distinct()
    some = F.filter(F.concat(F.array("gold_answer"), F.coalesce("supporting_facts", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    rows = t.select("trajectory_id", "final_answer", some.alias("golds")).where("final_answer is not null and size(golds) > 0")
    m = answers.all_metrics(F.col("final_answer"), F.col("golds"))
    return rows.select("trajectory_id", m.alias("m")).select("trajectory_id", "m.em", F.round("m.f1", 6).alias("f1"), "m.cover_tokens", "m.cover_phrase")


_MULTI_SQL = f"""with t as (select distinct trajectory_id, final_answer, gold_answer, supporting_facts from trajectories),
g as (select trajectory_id, final_answer, unnest(list_filter(list_prepend(gold_answer, coalesce(supporting_facts, cast([] as varchar[]))), lambda x: x is not null)) as gold from t where final_answer is not null),
n as (select trajectory_id, {views.sql_full("case final_answer when 'True' then 'yes' when 'False' then 'no' else final_answer end")} as p, {views.sql_full("case gold when 'True' then 'yes' when 'False' then 'no' else gold end")} as g from g),
s as (select *, {views.sql_tokens('p')} as pt, {views.sql_tokens('g')} as gt from n),
c as (select *, case when (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer')) and p <> g then 0 else {views.sql_same('pt', 'gt')} end as same from s)
select trajectory_id, max(cast(p = g as integer)) as em,
  round(max(case when same = 0 then 0.0 else 2.0 * (same / len(pt)) * (same / len(gt)) / (same / len(pt) + same / len(gt)) end), 6) as f1,
  max(cast(case when g in ('yes', 'no', 'noanswer') then coalesce(pt[1] = g, false) else len(list_filter(gt, lambda x: not list_contains(pt, x))) = 0 end as integer)) as cover_tokens,
  max(cast(case when g in ('yes', 'no', 'noanswer') or p in ('yes', 'no', 'noanswer') then p = g else contains(p, g) end as integer)) as cover_phrase
from c group by trajectory_id"""


def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer in every step's text, by the full cascade."""
    return views.steps(spark, sf_dir).select("trajectory_id", "step_id", answers.extract_answer(F.col("text")).alias("answer"))


def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sections of every step, and the action by either precedence."""
    s = views.steps(spark, sf_dir).where("text is not null")
    t = F.col("text")
    a, b = parse.tagged_action(t, "search"), parse.tagged_action(t, "answer")
    return s.select("trajectory_id", "step_id", *(parse.section(t, x).alias(x) for x in parse.SECTIONS), a["action"].alias("search_wins"), b["action"].alias("answer_wins"))


def _section_sql(tag: str) -> str:
    return f"case when regexp_matches(text, '<{tag}>(.*?)</{tag}>', 's') then trim(regexp_extract(text, '<{tag}>(.*?)</{tag}>', 1, 's'), E' \\t\\n\\r') end as {tag}"


_SECTIONS_SQL = f"""with {views.STEPS_SQL}, p as (select trajectory_id, step_id, {', '.join(_section_sql(t) for t in parse.SECTIONS)} from steps where text is not null)
select *, case when search is not null then 'search' when answer is not null then 'finish' end as search_wins, case when answer is not null then 'finish' when search is not null then 'search' end as answer_wins from p"""


def parse_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of output that may stop inside a tag."""
    s = views.steps(spark, sf_dir).where("text is not null")
    return s.select("trajectory_id", "step_id", parse.sections_open(F.regexp_replace("text", "^<think>", "")).alias("p")).select("trajectory_id", "step_id", "p.*")


def _open_sql(tag: str) -> str:
    return f"trim(regexp_extract(t, '<{tag}>(.*?)(?:</{tag}>|\\z)', 1, 's'), E' \\t\\n\\r')"


_OPEN_SQL = f"""with {views.STEPS_SQL}, x as (select trajectory_id, step_id, '<think>' || regexp_replace(text, '^<think>', '') as t from steps where text is not null)
select trajectory_id, step_id, {_open_sql('think')} as think, case when {_open_sql('answer')} = '' then {_open_sql('search')} else '' end as search, {_open_sql('answer')} as answer from x"""


def parse_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action and input of every step by the cascade over tags and legacy forms."""
    s = views.steps(spark, sf_dir).where("text is not null")
    return s.select("trajectory_id", "step_id", parse.action_of(F.col("text")).alias("a")).select("trajectory_id", "step_id", "a.action", "a.input")


_ACTION_RULES = [("finish", "<answer>(.+?)</answer>"), ("search", "<search>(.+?)</search>"), ("finish", "Action:\\s*Finish\\[answer\\s*=\\s*[\"'']?(.+?)[\"'']?\\]"), ("search", "Action:\\s*Search\\[query\\s*=\\s*[\"'']?(.+?)[\"'']?\\]"), ("reason", "Action:\\s*Reason\\[content\\s*=\\s*[\"'']?(.+?)[\"'']?\\]"), ("reason", "<think>(.+?)</think>")]
_ACTION_SQL = f"""with {views.STEPS_SQL} select trajectory_id, step_id,
case {' '.join(f"when regexp_matches(text, '{r}', 'si') then '{n}'" for n, r in _ACTION_RULES)}
  when contains(lower(text), 'final answer:') or contains(lower(text), 'the answer is') then 'finish' end as action,
case {' '.join(f"when regexp_matches(text, '{r}', 'si') then trim(regexp_extract(text, '{r}', 1, 'si'), E' \\t\\n\\r')" for _, r in _ACTION_RULES)} end as input
from steps where text is not null"""


def parse_numbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered steps in every step's text."""
    s = views.steps(spark, sf_dir)
    return s.select("trajectory_id", "step_id", F.posexplode(parse.numbered_steps(F.col("text")))).select("trajectory_id", "step_id", F.col("pos").alias("place"), "col.number", F.length("col.content").alias("length"))


_NUMBERED_SQL = f"""with {views.STEPS_SQL}, x as (select trajectory_id, step_id, text, regexp_extract_all(text, '^[ \\t]*Step[ \\t]+([0-9]+):', 1, 'm') as found from steps where text is not null and trim(text, E' \\t\\n\\r\u00a0') <> '')
select trajectory_id, step_id, cast(0 as integer) as place, case when len(found) > 0 then cast(found[1] as integer) else 1 end as number,
  cast(length(trim(regexp_replace(text, '^[ \\t]*Step[ \\t]+[0-9]+:', ''), E' \\t\\n\\r\u00a0')) as integer) as length from x"""


def parse_many_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered steps read back from whole trajectories of several steps."""
    s = views.steps(spark, sf_dir).where("trajectory_id is not null and step_id is not null").groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_id", F.coalesce("step_type", F.lit("none")).alias("t")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": a "), x["t"], F.lit(" step\nof two lines"))), "\n")
    return s.select("trajectory_id", F.posexplode(parse.numbered_steps(text))).select("trajectory_id", F.col("pos").alias("place"), "col.number", F.col("col.content").alias("content"))


_MANY_SQL = f"""with {views.STEPS_SQL}, n as (select trajectory_id, step_type, row_number() over (partition by trajectory_id order by step_id, coalesce(step_type, 'none')) as i from steps where trajectory_id is not null and step_id is not null)
select trajectory_id, cast(i - 1 as integer) as place, cast(i as integer) as number, 'a ' || coalesce(step_type, 'none') || ' step' || chr(10) || 'of two lines' as content from n"""


def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge responses of whole trajectories, written as fenced JSON with a trailing comma and read back."""
    j = views.judged(spark, sf_dir)
    item = F.to_json(F.struct((F.col("step_id") + 1).alias("step"), F.col("label"), F.coalesce("reasoning", F.lit("")).alias("reasoning")))
    whole = j.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_id", item.alias("item")))).alias("i"), (F.max("step_id") + 1).alias("n"))
    response = F.concat(F.lit("```json\n["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit(",]\n```"))
    read = whole.select("trajectory_id", F.explode(parse.judge_labels(response, F.col("n"))).alias("l"))
    return read.select("trajectory_id", (F.col("l.step") - 1).alias("step_id"), "l.label", (F.col("l.reasoning") == "Failed to parse response").alias("missing"))


_JUDGE_SQL = f"""with {views.LABELS_SQL}, n as (select trajectory_id, max(step_id) as last from judged group by trajectory_id),
s as (select trajectory_id, unnest(range(0, last + 1)) as step_id from n)
select s.trajectory_id, cast(s.step_id as integer) as step_id, coalesce(j.label, 'BAD') as label, j.label is null as missing from s left join judged j on s.trajectory_id = j.trajectory_id and s.step_id = j.step_id"""


def critic_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critic outputs put together from judge labels and read back, strictly and loosely."""
    j = views.judged(spark, sf_dir)
    out = F.concat(F.lit("[REASONING]\n"), F.coalesce("reasoning", F.lit("")), F.lit("\n[/REASONING]\nLabel: "), F.when(F.col("label") == "GOOD", "1").otherwise("0"))
    strict, loose = parse.critic_output(out), parse.critic_output(out, strict=False)
    return j.select("trajectory_id", "step_id", strict["score"].alias("score"), loose["score"].alias("loose_score"), parse.critic_label(out).alias("label"), F.length(strict["reasoning"]).alias("length"))


_CRITIC_SQL = f"""with {views.LABELS_SQL} select trajectory_id, step_id, cast(regexp_matches(coalesce(reasoning, ''), 'Label:\\s*1') or label = 'GOOD' as integer) as score, cast(label = 'GOOD' or contains(coalesce(reasoning, ''), '1') as integer) as loose_score,
case when label = 'GOOD' then 1 else 0 end as label, cast(length(trim(coalesce(reasoning, ''), E' \\t\\n\\r\u00a0')) as integer) as length from judged"""


def soft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft scores of steps from the log-probabilities of both labels."""
    v = views.votes(spark, sf_dir, "critic_step_scores", "critic_step_labels")
    s = v.select("trajectory_id", F.posexplode("critic_step_scores").alias("place", "s"), "critic_step_labels")
    one, zero = F.when(F.col("s") > 0, F.log("s")), F.when(F.col("s") < 1, F.log(1 - F.col("s")))
    return s.select("trajectory_id", "place", F.round(parse.soft_score(one, zero, F.get("critic_step_labels", F.col("place"))), 6).alias("soft"))


_SOFT_SQL = f"""with {views.VOTES_SQL}, s as (select trajectory_id, unnest(critic_step_scores) as s, generate_subscripts(critic_step_scores, 1) - 1 as place from votes)
select trajectory_id, cast(place as integer) as place, round(case when s > 0 and s < 1 then exp(ln(s)) / (exp(ln(s)) + exp(ln(1 - s))) when s >= 1 then 1 - 1e-6 else 1e-6 end, 6) as soft from s where s is not null"""


def step_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps taken apart and put together again, with search or answer and with both."""
    s = views.steps(spark, sf_dir).where("text is not null")
    p = s.select("trajectory_id", "step_id", *(parse.section(F.col("text"), x).alias(x) for x in parse.SECTIONS))
    parts = [F.col(x) for x in parse.SECTIONS]
    one = formatting.step_text(*(parts[i] for i in (0, 1, 2, 3)))
    both = formatting.step_text(*(parts[i] for i in (0, 1, 2, 3)), exclusive=False, documents_last=False)
    return p.select("trajectory_id", "step_id", one.alias("exclusive"), both.alias("inclusive"))


def _tag_sql(tag: str) -> str:
    return f"case when {tag} <> '' then '<{tag}>' || {tag} || '</{tag}>' end"


_DOCS = "case when documents <> '' then E'<documents>\\n' || documents || E'\\n</documents>' end"
_STEP_TEXT_SQL = f"""with {views.STEPS_SQL}, p as (select trajectory_id, step_id, {', '.join(_section_sql(t) for t in parse.SECTIONS)} from steps where text is not null)
select trajectory_id, step_id, concat_ws(E'\\n', {_tag_sql('think')}, {_tag_sql('search')}, case when coalesce(search, '') = '' then {_tag_sql('answer')} end, {_DOCS}) as exclusive,
concat_ws(E'\\n', {_tag_sql('think')}, {_tag_sql('search')}, {_DOCS}, {_tag_sql('answer')}) as inclusive from p"""


def observation_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents block of every step that used passages, best passage first."""
    s = views.steps(spark, sf_dir).select("trajectory_id", "step_id", F.explode("used_passages").alias("p")).select("trajectory_id", "step_id", "p.doc_id", "p.score")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ranked = s.join(d, "doc_id").groupBy("trajectory_id", "step_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "doc_id", F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return ranked.select("trajectory_id", "step_id", formatting.observation(F.col("p")).alias("block"))


_OBSERVATION_SQL = f"""with {views.STEPS_SQL}, s as (select trajectory_id, step_id, unnest(used_passages) as p from steps),
j as (select trajectory_id, step_id, coalesce(source, '') as title, coalesce(text, '') as text, row_number() over (partition by trajectory_id, step_id order by p.score desc, d.doc_id, coalesce(source, ''), coalesce(text, '')) as i from s join documents d on s.p.doc_id = d.doc_id)
select trajectory_id, step_id, E'<documents>\\n' || string_agg('[' || i || '] ' || title || ': ' || substring(text, 1, 500) || '...', E'\\n' order by i) || E'\\n</documents>' as block from j group by trajectory_id, step_id"""


def trajectory_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading, rollout and critic prompts of every trajectory from its steps."""
    s = views.steps(spark, sf_dir).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_id", F.coalesce("text", F.lit("")).alias("t")))).alias("s"))
    t = read_table(spark, sf_dir, "trajectories").groupBy("trajectory_id").agg(F.max("question").alias("question"), F.max("gold_answer").alias("gold_answer"))
    texts = F.transform("s", lambda x: x["t"])
    rows = t.join(s, "trajectory_id").withColumn("texts", texts)
    last, before = F.element_at("texts", -1), F.slice("texts", F.lit(1), F.size("texts") - 1)
    return rows.select("trajectory_id", formatting.rollout_prompt(F.col("question"), F.col("texts")).alias("rollout"), formatting.critic_prompt(F.col("question"), F.col("gold_answer"), before, last).alias("critic"), formatting.forcing_prompt(F.col("question"), F.col("texts")).alias("forcing"))


_PROMPTS_SQL = f"""with {views.STEPS_SQL}, s as (select trajectory_id, list(coalesce(text, '') order by step_id) as texts from steps group by trajectory_id),
t as (select trajectory_id, max(question) as question, max(gold_answer) as gold from trajectories group by trajectory_id), r as (select * from t join s using (trajectory_id))
select trajectory_id, concat_ws(E'\\n', 'Question: ' || question, array_to_string(texts, E'\\n'), 'Continue reasoning from here:') as rollout,
concat_ws(E'\\n\\n', E'# Question\\n' || question, case when gold <> '' then E'# Gold answer\\n' || gold end,
  case when len(texts) > 1 then E'# Previous steps\\n' || array_to_string(list_transform(texts[1:len(texts) - 1], lambda x, i: '## Step ' || i || E'\\n' || x), E'\\n') end,
  E'# Current step\\n' || texts[len(texts)], 'Judge the current step and give [REASONING]...[/REASONING] and Label: 1 or Label: 0.') as critic,
concat_ws(E'\\n', 'Question: ' || question, array_to_string(list_transform(texts, lambda x, i: 'Step ' || i || ': ' || x), E'\\n'), 'Step ' || (len(texts) + 1) || ':') as forcing from r"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs as chats in the template form."""
    p = read_table(spark, sf_dir, "preference_pairs")
    turns = F.array(formatting.message("system", F.lit("You answer step by step.")), formatting.message("user", F.col("prompt")), formatting.message("assistant", F.coalesce("chosen", F.lit(""))))
    return p.select("pair_id", formatting.chat_text(turns, open_assistant=False).alias("chat"), formatting.chat_text(F.slice(turns, 1, 2)).alias("prompt"))


_CHAT_SQL = """select pair_id, E'<|im_start|>system\\nYou answer step by step.<|im_end|>\\n<|im_start|>user\\n' || prompt || E'<|im_end|>\\n<|im_start|>assistant\\n' || coalesce(chosen, '') || E'<|im_end|>\\n' as chat,
E'<|im_start|>system\\nYou answer step by step.<|im_end|>\\n<|im_start|>user\\n' || prompt || E'<|im_end|>\\n<|im_start|>assistant\\n' as prompt from preference_pairs"""


def dedup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of passages with the same source and first 100 characters, numbered anew."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    key = F.concat(F.coalesce("source", F.lit("")), F.lit("::"), F.substring("text", 1, 100))
    first = d.groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"))
    from steploom.sources.files import with_ordinal

    return with_ordinal(first.select("doc_id"), "doc_id").select(F.concat(F.lit("doc_"), F.col("ord").cast("string")).alias("new_id"), "doc_id")


_DEDUP_SQL = "select 'doc_' || (row_number() over (order by doc_id) - 1) as new_id, doc_id from (select min(doc_id) as doc_id from documents where text is not null group by coalesce(source, '') || '::' || substring(text, 1, 100))"


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut with a mark, their first two sentences, and a position score."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.truncate_marked(F.col("text")).alias("cut"), F.round(text.position_score(F.col("doc_id") % 12), 6).alias("score"))


_TRUNCATE_SQL = "select doc_id, case when length(text) > 1200 then substring(text, 1, 1200) || ' [TRUNCATED]' else text end as cut, round(greatest(1 - 0.1 * (doc_id % 12), 0.1), 6) as score from documents where text is not null"


def reindex_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each trajectory numbered anew from 0, at most 50."""
    s = views.steps(spark, sf_dir)
    whole = s.groupBy("trajectory_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("step_id", "step_type"))), 1, 50).alias("s"))
    return whole.select("trajectory_id", F.posexplode("s")).select("trajectory_id", F.col("pos").alias("step_id"), F.col("col.step_id").alias("old_id"), "col.step_type")


_REINDEX_SQL = f"with {views.STEPS_SQL} select trajectory_id, cast(n - 1 as integer) as step_id, step_id as old_id, step_type from (select *, row_number() over (partition by trajectory_id order by step_id) as n from steps) where n <= 50"


def group_by_composite_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per question id carried in trajectory ids."""
    t = read_table(spark, sf_dir, "scored_trajectories")
    return t.groupBy(text.question_id_of(F.col("trajectory_id")).alias("question_id")).agg(F.countDistinct("trajectory_id").alias("n_trajectories"), F.max(text.sample_index_of(F.col("trajectory_id"))).alias("last_sample"))


_COMPOSITE_SQL = f"select {views.QID} as question_id, count(distinct trajectory_id) as n_trajectories, max(try_cast(nullif(regexp_extract(trajectory_id, '_sample_(\\d+)$', 1), '') as integer)) as last_sample from scored_trajectories group by 1"


def gold_in_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories whose gold answer stands in a document that one of their steps retrieved."""
    s = views.steps(spark, sf_dir).select("trajectory_id", text.normal_ascii(parse.section(F.col("text"), "documents")).alias("d"))
    t = read_table(spark, sf_dir, "trajectories").groupBy("trajectory_id").agg(F.max("gold_answer").alias("gold"))
    gold = text.normal_ascii(F.coalesce("gold", F.lit("")))
    return t.join(s, "trajectory_id").groupBy("trajectory_id").agg(F.max((gold == "") | F.coalesce(F.col("d").contains(gold), F.lit(False))).alias("hit"))


_GOLD_SQL = f"""with {views.STEPS_SQL}, d as (select trajectory_id, case when regexp_matches(text, '<documents>(.*?)</documents>', 's') then {views.sql_ascii("regexp_extract(text, '<documents>(.*?)</documents>', 1, 's')")} end as d from steps),
t as (select trajectory_id, {views.sql_ascii("coalesce(max(gold_answer), '')")} as gold from trajectories group by trajectory_id)
select trajectory_id, bool_or(gold = '' or coalesce(contains(d, gold), false)) as hit from t join d using (trajectory_id) group by trajectory_id"""


def doc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character spans of steps and retrieved documents in step texts."""
    s = views.steps(spark, sf_dir).where("text is not null")
    docs = s.select("trajectory_id", "step_id", F.lit("documents").alias("kind"), F.explode(masks.document_spans(F.col("text"))).alias("x"))
    think = s.select("trajectory_id", "step_id", F.lit("step").alias("kind"), F.explode(masks.step_spans(F.col("text"))).alias("x"))
    return docs.unionByName(think).select("trajectory_id", "step_id", "kind", "x.start", "x.end")


_SPANS_SQL = f"""with {views.STEPS_SQL}, d as (select trajectory_id, step_id, 'documents' as kind, instr(text, '<documents>') - 1 as s, instr(text, '</documents>') - 1 as e, length(text) as n from steps where contains(text, '<documents>')),
t as (select trajectory_id, step_id, 'step' as kind, instr(text, '<think>') - 1 as s, length(text) as n from steps where contains(text, '<think>'))
select trajectory_id, step_id, kind, cast(s as integer) as start, cast(case when e > s then e + 12 else n end as integer) as "end" from d union all select trajectory_id, step_id, kind, cast(s as integer), cast(n as integer) from t"""


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of step texts that are left to train on once retrieved documents are masked."""
    s = views.steps(spark, sf_dir).where("text is not null")
    # each step a column of its own, so that no array is made again for every element of another
    spans = s.select("trajectory_id", "step_id", masks.word_spans(F.col("text")).alias("w"), masks.document_spans(F.col("text")).alias("d"))
    hidden = spans.select("trajectory_id", "step_id", F.transform("w", lambda _, i: i).alias("ids"), masks.inside(F.col("w"), F.col("d")).alias("hidden"))
    labels = hidden.select("trajectory_id", "step_id", F.size("ids").alias("n_words"), masks.label_mask(F.col("ids"), F.col("hidden"), F.lit(1)).alias("labels"))
    return labels.select("trajectory_id", "step_id", "n_words", F.size(F.filter("labels", lambda x: x != masks.IGNORED)).alias("n_trained"))


_MASK_SQL = f"""with {views.STEPS_SQL}, x as (select trajectory_id, step_id, text, instr(text, '<documents>') as s, instr(text, '</documents>') as e from steps where text is not null),
w as (select *, len(regexp_extract_all(text, '[^\\s\u00a0]+')) as n, case when s > 0 then len(regexp_extract_all(substring(text, 1, s - 1), '[^\\s\u00a0]+')) end as before, case when s > 0 then len(regexp_extract_all(case when e > s then substring(text, s, e + 12 - s) else substring(text, s) end, '[^\\s\u00a0]+')) end as hidden from x)
select trajectory_id, step_id, cast(n as integer) as n_words, cast(case when n = 0 then 0 when s > 0 then n - hidden - (case when before > 0 then 1 else 0 end) else n - 1 end as integer) as n_trained from w"""


def token_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per document by source: fewest, most, mean and how many exceed 200."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min(n).alias("fewest"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n > 200).alias("exceeding"))


_PROFILE_SQL = f"select source, count(*) as n, cast(min(w) as integer) as fewest, cast(max(w) as integer) as most, round(avg(w), 6) as mean, count(*) filter (where w > 200) as exceeding from (select source, len({views.sql_tokens('text')}) as w from documents where text is not null) group by source"

_N = {"n1": (text.normal_full, views.sql_full), "n2": (text.normal_joined, views.sql_joined), "n3": (text.normal_bare, views.sql_bare), "n4": (text.normal_ascii, views.sql_ascii)}
QUERIES = {f"normalize_{k}": _normalise(f) for k, (f, _) in _N.items()} | {
    "answer_f1": answer_f1, "answer_em_cover": answer_em_cover, "metrics_multi_gold": metrics_multi_gold, "extract_answer": extract_answer, "parse_sections": parse_sections, "parse_open_ended": parse_open,
    "parse_action": parse_action, "parse_numbered_steps": parse_numbered_steps, "parse_many_steps": parse_many_steps, "judge_json": judge_json, "critic_output": critic_output, "soft_score": soft_scores, "step_to_text": step_to_text,
    "observation_block": observation_block, "format_prompt": trajectory_prompts, "chat_messages": chat_messages, "dedup_corpus": dedup_corpus, "truncate_text": truncate_text, "reindex_steps": reindex_steps,
    "group_by_composite_id": group_by_composite_id, "gold_in_docs": gold_in_docs, "doc_spans": doc_spans, "label_mask": label_mask, "token_length_profile": token_length_profile,
}
SQL = {f"normalize_{k}": _normalise_sql(e) for k, (_, e) in _N.items()} | {
    "answer_f1": _f1_sql(), "answer_em_cover": _EM_SQL, "metrics_multi_gold": _MULTI_SQL, "parse_sections": _SECTIONS_SQL, "parse_open_ended": _OPEN_SQL, "parse_action": _ACTION_SQL,
    "parse_numbered_steps": _NUMBERED_SQL, "parse_many_steps": _MANY_SQL, "judge_json": _JUDGE_SQL, "critic_output": _CRITIC_SQL, "soft_score": _SOFT_SQL, "step_to_text": _STEP_TEXT_SQL, "observation_block": _OBSERVATION_SQL,
    "format_prompt": _PROMPTS_SQL, "chat_messages": _CHAT_SQL, "dedup_corpus": _DEDUP_SQL, "truncate_text": _TRUNCATE_SQL, "reindex_steps": _REINDEX_SQL, "group_by_composite_id": _COMPOSITE_SQL,
    "gold_in_docs": _GOLD_SQL, "doc_spans": _SPANS_SQL, "label_mask": _MASK_SQL, "token_length_profile": _PROFILE_SQL,
}
