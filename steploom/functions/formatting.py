"""Steps and trajectories as text: tags, observations, prompts, chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tagged(tag: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>")))


def step_text(think: Column, search: Column, answer: Column, documents: Column, exclusive: bool = True, documents_last: bool = True) -> Column:
    """A step in tags, one a line. Exclusive: a search leaves the answer out."""
    a = _tagged("answer", answer)
    if exclusive:
        a = F.when(F.coalesce(search, F.lit("")) == "", a)
    docs = F.when(F.coalesce(documents, F.lit("")) != "", F.concat(F.lit("<documents>\n"), documents, F.lit("\n</documents>")))
    order = [_tagged("think", think), _tagged("search", search), a, docs] if documents_last else [_tagged("think", think), _tagged("search", search), docs, a]
    return F.concat_ws("\n", *order)


def joined_steps(steps: Column, separator: str = "\n") -> Column:
    """An array of step texts as one text."""
    return F.array_join(steps, separator)


def observation(passages: Column, limit: int = 500) -> Column:
    """Passages (struct title, text) as a numbered documents block."""
    lines = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit(": "), F.substring(p["text"], 1, limit), F.lit("...")))
    return F.concat(F.lit("<documents>\n"), F.array_join(lines, "\n"), F.lit("\n</documents>"))


def split_contents(contents: Column) -> Column:
    """struct(title, text) of a passage whose first line is its title."""
    title = F.substring_index(contents, "\n", 1)
    return F.struct(F.regexp_replace(title, "^\"|\"$", "").alias("title"), F.substring(contents, F.length(title) + 2, F.length(contents)).alias("text"))


def document_block(contents: Column) -> Column:
    """Passages (title line and text) as "Doc i(Title: t) text" lines."""
    parts = F.transform(contents, split_contents)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), p["title"], F.lit(") "), p["text"])), "\n")


def trajectory_prompt(question: Column, steps: Column, final_answer: Column, observed: int = 100) -> Column:
    """Question, numbered steps (struct action, observation) and answer as a reading text."""
    lines = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), F.coalesce(s["action"], F.lit("")), F.lit("\nObservation: "), F.substring(F.coalesce(s["observation"], F.lit("")), 1, observed)))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.array_join(lines, "\n"), F.concat(F.lit("Final answer: "), F.coalesce(final_answer, F.lit(""))))


def rollout_prompt(question: Column, prefix: Column) -> Column:
    """Question and the steps so far, to be continued."""
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.array_join(prefix, "\n"), F.lit("Continue reasoning from here:"))


def critic_prompt(question: Column, gold: Column, previous: Column, current: Column) -> Column:
    """Question, gold answer if known, earlier steps and the step to be judged."""
    before = F.transform(previous, lambda s, i: F.concat(F.lit("## Step "), (i + 1).cast("string"), F.lit("\n"), s))
    head = F.concat(F.lit("# Question\n"), question)
    known = F.when(F.coalesce(gold, F.lit("")) != "", F.concat(F.lit("# Gold answer\n"), gold))
    past = F.when(F.size(previous) > 0, F.concat(F.lit("# Previous steps\n"), F.array_join(before, "\n")))
    return F.concat_ws("\n\n", head, known, past, F.concat(F.lit("# Current step\n"), current), F.lit("Judge the current step and give [REASONING]...[/REASONING] and Label: 1 or Label: 0."))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def critic_messages(system: str, prompt: Column, reasoning: Column, label: Column) -> Column:
    """System, user and assistant messages of a critic's training row."""
    reply = F.concat(F.lit("[REASONING]\n"), reasoning, F.lit("\n[/REASONING]\nLabel: "), label.cast("string"))
    return F.array(message("system", F.lit(system)), message("user", prompt), message("assistant", reply))


def chat_text(messages: Column, open_assistant: bool = True) -> Column:
    """Messages (struct role, content) in the im_start/im_end template."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if open_assistant else text


def forcing_prompt(question: Column, done: Column, final: bool = False) -> Column:
    """Prompt that forces the next numbered step, or the final answer."""
    so_far = F.array_join(F.transform(done, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    head = F.concat(F.lit("Question: "), question)
    nxt = F.lit("Final Answer:") if final else F.concat(F.lit("Step "), (F.size(done) + 1).cast("string"), F.lit(":"))
    return F.concat_ws("\n", head, F.when(F.size(done) > 0, so_far), nxt)


def correction_prompt(question: Column, steps: Column, bad_index: Column, reason: Column, searches: Column) -> Column:
    """The whole attempt, the step that failed and why, and the queries not to be repeated."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(":\n"), s)), "\n")
    used = F.filter(searches, lambda q: F.coalesce(q, F.lit("")) != "")
    avoid = F.when(F.size(used) > 0, F.concat(F.lit("Do NOT repeat these searches:\n"), F.array_join(F.transform(used, lambda q: F.concat(F.lit("- "), q)), "\n")))
    wrong = F.concat(F.lit("Step "), (bad_index + 1).cast("string"), F.lit(" is wrong: "), F.coalesce(reason, F.lit("")))
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), numbered, wrong, avoid)


def scorer_text(question: Column, steps: Column, separator: str) -> Column:
    """Question and step texts with a separator behind every step, for a step scorer."""
    return F.concat(question, F.lit("\n"), F.array_join(F.transform(steps, lambda s: F.concat(s, F.lit(separator))), ""))


def judge_prompt(question: Column, gold: Column, steps: Column) -> Column:
    """A whole trajectory to be judged step by step, the answer asked for as JSON."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("## Step "), (i + 1).cast("string"), F.lit("\n"), s)), "\n\n")
    ask = F.lit('Judge every step. Answer with a JSON array of {"step": n, "label": "GOOD" or "BAD", "reasoning": "..."}.')
    return F.concat_ws("\n\n", F.concat(F.lit("# Question\n"), question), F.concat(F.lit("# Gold answer\n"), F.coalesce(gold, F.lit(""))), F.concat(F.lit("# Steps\n"), numbered), ask)


def feedback_prompt(question: Column, prefix: Column, feedback: Column, limit: int = 500) -> Column:
    """The steps that were right, and what was said about the one that failed."""
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.array_join(prefix, "\n"), F.concat(F.lit("A critic said: "), F.substring(F.coalesce(feedback, F.lit("")), 1, limit)), F.lit("Write a better next step."))


def response_template(chat: Column, marker: str = "assistant", width: int = 100, fallback: int = 30) -> Column:
    """What a chat template writes before the assistant's turn: up to the last marker, at most ``width``."""
    at = F.length(chat) - F.instr(F.reverse(chat), marker[::-1]) + 1
    found = F.instr(chat, marker) > 0
    known = F.substring(chat, 1, F.when(found, at).otherwise(0))
    return F.when(found, F.right(known, F.lit(width))).otherwise(F.right(chat, F.lit(fallback)))


def percent_report(rows: dict[str, Column], total: Column) -> Column:
    """Counts and their percentages as lines of text."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(" ("), F.format_string("%.1f", 100 * F.coalesce(F.try_divide(value, total), F.lit(0.0))), F.lit("%)")) for name, value in rows.items()]
    return F.concat_ws("\n", *lines)
