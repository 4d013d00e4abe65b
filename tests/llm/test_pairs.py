import pytest

from dialogforge.llm import pairs

M = "dialogue_id string, turn_id int, msg_id bigint, msg_index int, role string, content string, code_snippet string, dup string"
ASK = "Why does the parser skip the second queue when the first worker has already stopped? Please keep the order."
ANSWER = "The fix is to drain the queue before the worker looks at it, because the buffer may be stale by then."


@pytest.mark.parametrize("content", [None, "", " \n", "​", "...", "N/A", "(no answer)", "[]", "```\n```", "—", "Keine Antwort."])
def test_empty(content):
    assert pairs.defect_of(ASK, content, False) == "empty"
    assert pairs.defect_of(ASK, content, True) is None


@pytest.mark.parametrize("content", ["42", "true", "Done.", "No, the order does not matter here.", "LGTM", ANSWER])
def test_real_answers(content):
    assert pairs.defect_of(ASK, content, False) is None


@pytest.mark.parametrize("content", [ASK, f"> {ASK}", ASK.lower(), f'"{ASK}" Is that what you asked?', f"Question: {ASK}\nAnswer: {ASK}", ASK.replace(" ", "  "), "Please keep the order. Why does the parser skip the second queue when the first worker has already stopped?"])
def test_copies(content):
    assert pairs.defect_of(ASK, content, False) == "copy"


def test_a_quotation_with_an_answer_is_no_copy():
    assert pairs.defect_of(ASK, f"> {ASK}\n\n{ANSWER}", False) is None


@pytest.mark.parametrize("content", ["I'm sorry, but I can't help with the parser.", "Thank you for the details. I must respectfully decline to drain the queue for you.", "Leider darf ich zu parse_queue keine Auskunft geben.", "This is something I'm unable to do. Please ask something else."])
def test_refusals(content):
    assert pairs.defect_of(ASK, content, False) == "refusal"


@pytest.mark.parametrize("content", [f"Sorry for the confusion in my last reply. {ANSWER}", f"I'm not able to run parse_queue from here, so I read it line by line. {ANSWER}", f"I can't help with the cache, but the queue is simple. {ANSWER}"])
def test_apologies_with_an_answer(content):
    assert pairs.defect_of(ASK, content, False) is None


@pytest.mark.parametrize("content", [ANSWER[:60], ANSWER + "\n\n```python\nx = 1", ANSWER + " Since the queue is shared,", f"1. {ANSWER}\n2. {ANSWER}\n3.", f"1. {ANSWER}\n2. The", "It changes three things:\n- the queue in `parse_a`\n- the worker in `pa", ANSWER + " The new version:"])
def test_truncated(content):
    assert pairs.defect_of(ASK, content, False) == "truncated"


@pytest.mark.parametrize("content", ["It changes:\n- the queue in `parse_a`\n- the worker in `parse_b`", ANSWER + " More on this at https://docs.example/a", ANSWER + "\n\n```python\nx = 1\n```", ANSWER + "​"])
def test_finished_without_full_stop(content):
    assert pairs.defect_of(ASK, content, False) is None
    assert pairs.defect_of(ASK, ANSWER + " The new version:", True) is None


def test_languages():
    german = "Der Fehler liegt in der Liste, weil sie nur einmal gelesen und danach nicht mehr erneuert wird."
    assert pairs.defect_of(ASK, german, False) == "other_language"
    assert pairs.defect_of(ASK + " Please write the reply in German.", german, False) is None
    assert pairs.defect_of("Warum ist die Liste leer, wenn der Lauf beginnt und nicht endet?", german, False) is None
    assert pairs.defect_of("parse_a parse_b", german, False) is None


def test_lcs():
    assert pairs.lcs_length(list("abcbdab"), list("bdcaba")) == 4
    assert pairs.lcs_length([], ["a"]) == 0


def test_table(spark):
    rows = [
        ("d", 1, 1, 0, "User", ASK, None, "x"), ("d", 1, 2, 1, "model", None, None, "x"), ("d", 1, 2, 1, "model", None, None, "x"),
        ("d", 2, 3, 2, "human", ASK, None, None), ("d", 2, 4, 3, "assistant", ANSWER, None, None),
        ("d", 3, 5, 4, "user", ASK, None, None),
        ("d", None, 6, 5, "user", ASK, None, None), (None, 1, 7, 0, "assistant", None, None, None),
        ("d", 4, 8, 6, "user", None, None, None), ("d", 4, 9, 7, "ASSISTANT", "", "code", None),
        ("d", 0, 10, 0, "system", "s", None, None),
        ("e", 1, 11, 0, "user", ASK * 2000, None, None), ("e", 1, 12, 1, "assistant", ANSWER * 2000 + " and", None, None),
    ]
    df = spark.createDataFrame(rows, M)
    assert {tuple(r) for r in pairs.find_defects(df).collect()} == {("d", 1, "empty"), ("e", 1, "truncated")}
    assert pairs.find_defects(df.limit(0)).count() == 0


SUBJECT = "moving the nightly billing export of the northern warehouse to the new queue"


@pytest.mark.parametrize("content", [f"I can't help with {SUBJECT}.", f"I'm sorry, but I can't help with {SUBJECT} and {SUBJECT}. Thank you for the details.", f"It would not be appropriate for me to touch the {SUBJECT} or {SUBJECT}.", f"Leider darf ich zu {SUBJECT} keine Auskunft geben.", f"As far as {SUBJECT} is concerned, I must decline.", " ".join([f"I can't help with {SUBJECT}."] * 12)])
def test_refusals_of_any_length(content):
    assert pairs.defect_of(ASK, content, False) == "refusal"


@pytest.mark.parametrize("content", [f"I can't help with the cache, but {ANSWER}", f"I can't help with {SUBJECT}. {ANSWER}", f"I see that the worker drains the queue before it looks at {SUBJECT}, so this must not decline to keep the order of the second queue when it is done.", f"{ANSWER} " * 12 + f"I can't help with {SUBJECT}."])
def test_long_answers_are_no_refusals(content):
    assert pairs.defect_of(ASK, content, False) is None


def test_other_scripts():
    question = "Why does the parser drop the last token of this line?"
    chinese, japanese, russian = "解析器在读取最后一个标记之前就停止了，因此需要先刷新缓冲区。", "パーサーは最後のトークンを読む前に止まります。", "Парсер останавливается до последнего токена, поэтому его нужно сбросить."
    for answer in (chinese, japanese, russian):
        assert pairs.defect_of(question, answer, False) == "other_language"
        assert pairs.defect_of(answer, "The parser stops before the last token, so that it has to be flushed.", False) == "other_language"
    assert pairs.defect_of(chinese, chinese[4:] + "请先检查缓冲区的大小设置。", False) in (None, "copy")
    assert pairs.defect_of("Answer in Chinese: " + question, chinese, False) is None
    assert pairs.defect_of(question, "The sign 解析 stands for parsing, as the author of the file says.", False) is None
    assert {pairs.language(x) for x in (chinese, japanese, russian)} == {"zh", "ja", "cyrillic"}


def test_a_reordered_copy():
    prompt = "the parser drops the last token of every line when the buffer is full and nobody knows why"
    words = prompt.split()
    assert pairs.defect_of(prompt, " ".join(words[::-1]) + ".", False) == "copy"
    assert pairs.defect_of(prompt, "It drops the token because the buffer is flushed before the last line was read; flush it later.", False) is None
