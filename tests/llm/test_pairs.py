import pytest

from steploom.llm.pairs import broken_sides

CHAT = "<|im_start|>system\nThink.<|im_end|>\n<|im_start|>user\nQuestion: {}<|im_end|>\n<|im_start|>assistant\n<think>x.</think>\n"
EN = "Which place did Ann Orlo leave for Bea Minko?"
ES = "¿En qué año fue vendido el molino de Orlo a la familia Minko?"
CASES = [
    (EN, None, "empty"), (EN, "", "empty"), (EN, " ​\n", "empty"), (EN, "<think></think>\n<answer>.</answer>", "empty"), (EN, "...", "empty"),
    (EN, "Orlo Bay", None), (EN, "yes", None), (EN, "1,503.", None), (EN, "<answer>the Orlo Press</answer>", None),
    (EN, EN, "copies_prompt"), (EN, f"<answer>{EN.upper()}</answer>", "copies_prompt"), (EN, f"Question: {EN}", "copies_prompt"), (EN, f"{EN} {EN}", "copies_prompt"), (EN, EN[:-1], "copies_prompt"),
    (EN, f"{EN} She left Orlo Bay.", None), (EN, f"<think>{EN}</think>\n<answer>Orlo Bay</answer>", None),
    (EN, "I'm sorry, but I cannot assist with this request.", "refusal"), (EN, "<think>I am not able to answer this.</think>\n<answer></answer>", "refusal"),
    (ES, "Lo siento, pero debo negarme a contestar.", "refusal"), (ES, "As an AI system, I can't help with that question.", "refusal"),
    (EN, "Il m'est impossible de répondre à cela.", "refusal"), (EN, "Ich darf dazu keine Antwort geben.", "refusal"),
    (EN, "I cannot find Ann in passage 4, so I search for Bea instead.", None), (EN, "The council declined to answer Orlo, which is why Bea left in 1713.", None), (EN, "Orlo refused to help Bea in 1740, according to the register.", None), (EN, "Sorry to say, the archive burned down, but Bea kept copies.", None),
    (EN, "It cannot be Orlo, because Bea was clo", "truncated"), (EN, "<think>It was sold before 1900.", "truncated"), (EN, "<think>Sold.</think>\n<answer>Orlo</ans", "truncated"), (EN, "So Orlo was sold to Bea for approx.", "truncated"), (EN, 'The sign reads "La coleccion de Orlo', "truncated"),
    (EN, "Después de la huelga de 1958, Orlo dejó la ciudad y fundó una escuela pequeña.", "other_language"), (EN, "答案是 Orlo,因为 Minko 的档案有页保存在那里。", "other_language"), (ES, "It was closed before 1900, because the owner left.", "other_language"),
    (ES, "Después de la huelga de 1958, Orlo dejó la ciudad y fundó una escuela pequeña.", None), (EN, 'It was sold. The sign reads "Después de la huelga de 1958, Orlo dejó la ciudad y fundó una escuela." in the old spelling.', None),
    (None, "It was sold before 1900.", None), (None, None, "empty"), (EN, "word " * 20000 + "end.", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, wrap(p), a, "good answer.", "x", 1) for k, (p, a, _) in enumerate(CASES) for wrap in ((lambda p: p),)]
    rows += [(1000 + k, p and CHAT.format(p), a, "good answer.", "x", 1) for k, (p, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string, defect string, __text int")
    return {(r.pair_id, r.side): r.defect for r in broken_sides(df, "pair_id", "prompt", ["chosen", "rejected"]).collect()}


def test_cases(found):
    wrong = [(CASES[k % 1000], found.get((k, "chosen"))) for k in [*range(len(CASES)), *range(1000, 1000 + len(CASES))] if found.get((k, "chosen")) != CASES[k % 1000][2]]
    assert not wrong
    assert not [k for k in found if k[1] == "rejected"]


def test_repeated_rows_and_empty_table(spark):
    schema = "pair_id long, prompt string, chosen string, rejected string"
    rows = spark.createDataFrame([(1, EN, "", "yes")] * 2, schema)
    assert broken_sides(rows, "pair_id", "prompt", ["chosen", "rejected"]).count() == 2
    assert broken_sides(spark.createDataFrame([], schema), "pair_id", "prompt", ["chosen", "rejected"]).count() == 0
