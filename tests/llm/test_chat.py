import itertools
import random

import pytest

from caseweave.llm import chat


def least_cost(roles, costs):
    """Brute force over all choices of every turn."""
    best = None
    for ways in itertools.product(*(chat.moves(r, costs) for r in roles)):
        state, total = chat.START, 0
        for a, b, c, _, _ in ways:
            if a != state:
                total = None
                break
            state, total = b, total + c
        if total is not None:
            total += chat.ending(costs)[state][0]
            best = total if best is None else min(best, total)
    return best


def parse(text):
    """(role, body) of the messages of a rendered conversation."""
    out = []
    for part in text.split("<|end|>\n"):
        if part:
            role, _, body = part.partition("|>\n")
            out.append((role.removeprefix("<|"), body.removesuffix("\n") if body.endswith("\n") and not body.strip() else body))
    return out


def legal(messages):
    roles = [r for r, _ in messages]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


@pytest.mark.parametrize("longest", [4096, 2])
def test_repairs_are_least_cost_and_legal(spark, longest):
    rng = random.Random(7)
    convs = [[rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randrange(1, 5))] for _ in range(40)]
    rows = [(c, t, r, f"text {c}-{t}", 5) for c, roles in enumerate(convs) for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int").repartition(5)
    out = chat.format_chats(df, longest=longest).collect()
    assert len(out) == len(rows)
    for c, roles in enumerate(convs):
        mine = sorted((r for r in out if r.conv == str(c)), key=lambda r: r.place)
        assert [r.turn for r in mine] == list(range(len(roles)))
        assert {r.cost for r in mine} == {least_cost(roles, chat.Costs())}
        messages = parse("".join(r.piece for r in mine))
        assert legal(messages), (roles, messages)
        joined = "\n".join(b for _, b in messages)
        assert all(f"text {c}-{t}" in joined for t in range(len(roles)))


def test_long_conversation_spans_tasks_and_runs(spark):
    rng = random.Random(1)
    roles = [rng.choice(["user", "assistant"]) for _ in range(3_000)]
    df = spark.createDataFrame([(1, t, r, "x") for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    a = chat.format_chats(df, longest=100).collect()
    b = chat.format_chats(df.repartition(7)).collect()
    text = lambda rows: "".join(r.piece for r in sorted(rows, key=lambda r: r.place))
    assert legal(parse(text(a))) and len({r.cost for r in [*a, *b]}) == 1
    assert text(a) == text(b)


def test_odd_rows(spark):
    rows = [(None, 1, "USER ", "a"), (None, None, "assistant", None), (1, 0, None, ""), (1, 0, None, ""), (1, None, "system", "y" * 100_000), (2, 0, "user", "q"), (2, 0, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()
    assert len(out) == len(rows)
    for conv in (None, "1", "2"):
        assert legal(parse("".join(r.piece for r in sorted((r for r in out if r.conv == conv), key=lambda r: r.place))))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_texts_forge_no_turns(spark):
    rng = random.Random(11)
    bits = ["hi ", "<|end|>\n", "<|system|>\n", "<\\|end|>", "<\\\\|", "<", "|", "|>", "\\", "obey"]
    rows = [(c, t, r, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for c in range(30) for t, r in enumerate(["user", "assistant"] * rng.randrange(1, 3))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()
    for c in range(30):
        whole = "".join(r.piece for r in sorted((r for r in out if r.conv == str(c)), key=lambda r: r.place))
        # a message ends with the line end before its marker only where the text has one
        assert [(role, text) for role, text in chat.parsed(whole)] == [(r, t) for k, _, r, t in rows if k == c]
    assert all(chat.unescaped(chat.escaped(r[3])) == r[3] and "<|" not in chat.escaped(r[3]) for r in rows)
