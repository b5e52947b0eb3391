import hashlib
import random

from larkspur.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_end|>", "|im_start|>", "<SYS>>", "/SYS>>", "ok", "\n", " "]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert chat.START not in e and chat.END not in e and "</s>" not in e and "[INST]" not in e and "[/INST]" not in e
        assert chat._unescape_role(chat._escape_role(t)) == t and "\n" not in chat._escape_role(t)


def test_any_control_string_is_escaped():
    for c in ("<|reserved_special_token_0|>", "<|Im_start|>", "<|" + "a" * 40 + "|>", "<|x y|>", "<\uff5cbegin\uff5c>", "<S>", "</s>", "<eos>", "<start_of_turn>", "[inst]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TOOL_CALLS]"):
        e = chat.escape(f"a {c}{c} b")
        assert c not in e and chat.unescape(e) == f"a {c}{c} b", c
    assert chat.escape("<b>x</b> a < b [1] [note]") == "<b>x</b> a < b [1] [note]"


def test_own_count_and_clashing_columns(spark):
    rows = [(1, k, "user", "x" * 10, "y", 5) for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string, loss int")
    got = chat.format_chats(df, budget=50, history=0, count=len).collect()
    assert [r.n_turns for r in got] == [3] * 6 + [2] and all(r.n_tokens == 14 * r.n_turns for r in got)
    assert chat.chat_digests(df, budget=50, history=0, count=len).collect()[0].n_turns == 20


def conversations():
    rng = random.Random(7)
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 5, 60])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool\nx"])
            text = " ".join(rng.choices(["word", "</s>", "[INST]", "a\nb", "\\", chat.START], k=rng.choice([0, 3, 30, 200])))
            rows.append((conv, turn, role, text, "x"))
    rows += [(900, 0, "user", None, None), (900, None, None, "late", None), (901, 0, "assistant", "same", "x"), (901, 0, "assistant", "same", "x"), (None, 3, "user", "q", "x"), (2**60 + 1, 0, "assistant", "w " * 100_000, None)]
    return rows


def test_windows_keep_the_budget(spark):
    rows = conversations()
    for w in chat.format_chats(spark.createDataFrame(rows, SCHEMA), budget=100, history=30).collect():
        turns = chat.read_window(w.text)
        cost = sum(chat.count_tokens(t) + chat.TURN_TOKENS for _, t in turns)
        assert cost == w.n_tokens and len(turns) == w.n_turns
        assert cost <= 100 or w.n_turns - w.n_context == 1
        if w.window and (w.conv_id or 1) % 3 == 0 and w.conv_id < 40:
            assert turns[0][0] == "system" and w.n_context >= 1


def test_digests(spark):
    rows = conversations()
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, SCHEMA), budget=100, history=30).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns))
        target = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(target), sha(target))
        assert r.formatted_chars >= sum(len(t[3] or "") for t in turns)


def test_empty(spark):
    assert chat.chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0
