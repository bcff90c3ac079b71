import hashlib
import random
import re
import zlib

import pytest
from llm_data import prepare

from sensorloom.llm import conversations as c
from sensorloom.llm.queries import op12_conversations

SCHEMA = "conv_id long, turn long, role string, text string, _digest string, fault string"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def faults(rows):
    """(role, text, fault) in order, by the definition."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(turns):
    """Least (cost, audit, lines) over all edit sequences, by plain search on what was emitted so far."""
    states = {"": (0, "", ())}  # the last initial stands for the state: nothing, s, u, a

    def offer(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def emit(table, state, value, role, text, cost, edit):
        initial = role[:1]
        if (initial == "s" and state == "") or (initial == "u" and state in ("", "s", "a")) or (initial == "a" and state == "u"):
            offer(table, initial, (value[0] + cost, value[1] + edit, (*value[2], f"{role}:{text}")))

    def inserted(table):
        for _ in range(4):
            for state, value in list(table.items()):
                for role in ("user", "assistant"):
                    emit(table, state, value, role, "", 5, "I")

    for role, text, fault in turns:
        inserted(states)
        after = {}
        for state, value in states.items():
            offer(after, state, (value[0] + 2, value[1] + "D", value[2]))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            emit(after, state, value, role, text, extra, "K")
            for other in ("user", "assistant"):
                if other != role:
                    emit(after, state, value, other, text, extra + 1, "R")
        states = after
    inserted(states)
    return min((v for s, v in states.items() if s in ("", "a")), key=lambda v: v[:2])


def brute(conv, rows):
    turns = faults(rows)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    counts = [sum(f == name for _, _, f in turns) for name in ("blank", "duplicate", "truncated")]
    initials = [r[:1] for r, _, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = cheapest(turns)
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def filled(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return groups


def random_rows(seed, conversations=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut", "é.", " \t", "", None, "long " * rng.randint(1, 400) + ". \n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "cut"), (900, None, None, None)]
    return rows


def test_against_search(spark):
    rows = random_rows(1)
    report = c.repair_conversations(frame(spark, rows))
    assert report.columns == ["conv_id", *(n for n, _ in c.REPORT)]
    assert {tuple(r) for r in report.collect()} == {brute(conv, turns) for conv, turns in filled(rows).items()}


@pytest.mark.parametrize("turns", [1, 3])
def test_settling_early_changes_nothing(monkeypatch, turns):
    monkeypatch.setattr(c, "HELD_TURNS", turns)
    for conv, rows in filled(random_rows(turns, 400)).items():
        conversation = c._Conversation()
        seen = {}
        for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
            numbers = seen.setdefault((role, text), [t for t, r, x in rows if (r, x) == (role, text)])
            first = min((t for t in numbers if t is not None), default=turn)
            fault = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "n" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t"
            conversation.add(turn, role, text, fault, first, None in numbers)
        assert (conv, *conversation.report()) == brute(conv, rows)


def test_one_very_long_conversation_is_streamed():
    rng = random.Random(8)
    turns = [(rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", ""])) for _ in range(4000)]
    conversation = c._Conversation()
    seen, classed = set(), []
    for i, (role, text) in enumerate(turns):
        fault = "b" if not text else "t" if text == "cut" else "n"
        conversation.add(i, role, text, fault, min(i, 0 if (role, text) in seen else i), False)
        classed.append((role, text, "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text == "cut" else ""))
        seen.add((role, text))
        assert len(conversation.turns) <= c.HELD_TURNS
    cost, audit, lines = cheapest(classed)
    assert conversation.report()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_parser_accepts_just_the_role_grammar():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("sua", k=rng.randint(0, 7)))
        stack = c.BOTTOM
        for initial in text:
            stack = stack and c._shift(stack, initial)
        assert (stack is not None and c.MAY_END[stack[0]]) == bool(re.fullmatch("(s?(ua)+)?", text))


def test_damage_and_query(spark, tmp_path):
    rows = [(conv, turn, role, text) for conv, turn, role, text in random_rows(5, 400) if conv != 3] + [(None, None, "user", "A. B? C!")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    left = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = {brute(conv, turns) if turns else (conv, *empty) for conv, turns in left.items()}
    assert {tuple(r) for r in op12_conversations(spark, str(tmp_path)).collect()} == wanted
    assert any(r[1:] == empty for r in wanted)


def test_empty_table(spark):
    assert c.repair_conversations(frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
