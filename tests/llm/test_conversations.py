"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfspark.llm import auction_paths, conversations

COLUMNS = "conv_id long, turn long, role string, text string, run long, conv string, codes string, mark string, tie int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "d", "m", 0) for r in rows], COLUMNS)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def mark(row):
    return hashlib.md5(f"{len(row[2])}:{row[2]}{row[3]}".encode()).hexdigest()


def cheapest(codes):
    """Least (cost, edits) over all states by reading messages one by one."""
    step = lambda state: 2 if state in (0, 1, 3) else 3
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                to = (cost + 2, audit + "I", out + ["user:" if state != 2 else "assistant:"])
                if step(state) not in best or to[:2] < best[step(state)][:2]:
                    best[step(state)] = to
        return best

    best = inserted({0: (0, "", [])})
    for code, (role, text) in codes:
        after = {}

        def offer(state, value, after=after):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for state, (cost, audit, out) in best.items():
            offer(state, (cost + 3, audit + "D", out))
            if code != "-":
                extra = 1 if code.isupper() else 0
                if (code.lower(), state) in kept:
                    offer(kept[code.lower(), state], (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
                offer(step(state), (cost + 2 + extra, audit + "R", [*out, f"{'assistant' if state == 2 else 'user'}:{text}"]))
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def by_hand(original):
    groups = {r[0]: [] for r in original}
    for row in damaged(original):
        groups[row[0]].append(row)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], mark(r)))
        counts, seen, codes = {"-": 0, "=": 0, "^": 0}, set(), []
        for _, _, role, text in rows:
            plain = text.strip(" \t\n\x0b\x0c\r")
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code = "-" if not plain else "=" if (role, text) in seen else initial.upper() if plain[-1] not in ".!?" else initial
            seen.add((role, text))
            counts["^" if code.isupper() else code] = counts.get("^" if code.isupper() else code, 0) + 1
            codes.append(("-" if code == "=" else code, (role, text)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(codes)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["-"], counts["="], counts["^"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def messages(seed=1, long=0):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ua", "User"]
    texts = ["Yes.", "No!", "Why?", "and so", "  ", "", None, "x\ny.", "Ünïcode ok. \t\n", "a.b"]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randrange(0, 9)):
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"{rnd.randrange(50)} {rnd.choice(texts)}" if rnd.random() < 0.6 else rnd.choice(texts)
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]) if rnd.random() < 0.2 else turn, role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo."), (77, None, None, None), (78, 5, "user", "y " * 50_000 + "."), (79, 1, "system", "S.")]
    rows += [rows[3], rows[3], (80, 9, "assistant", "same."), (80, 9, "assistant", "same."), (80, 10, "assistant", "same.")]
    for turn in range(long):
        rows.append((500, turn, rnd.choice(roles[:4]), f"{turn % 97} {rnd.choice(texts)}"))
    rnd.shuffle(rows)
    return rows


def test_damage(spark):
    rows = messages()
    got = [tuple(r) for r in conversations.damage(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(damaged(rows), key=repr)


def test_auction_finds_the_cheapest_and_least_edits():
    rnd = random.Random(4)
    for codes in [*("".join(c) for n in range(4) for c in itertools.product("suaxUA-", repeat=n)), *("".join(rnd.choices("suaxSUAX-", k=rnd.randrange(5, 40))) for _ in range(200))]:
        cost, leave, labels = auction_paths.auction(codes, 0, auction_paths.ACCEPTED)
        wanted = cheapest([(c, ("r", "t")) for c in codes])
        assert (cost, labels) == wanted[:2], codes
        assert leave in (0, 3) and len(auction_paths.placed(labels, 0, codes)[1]) == len(codes)


@pytest.mark.parametrize("run, fan_in, long", [(64, 64, 0), (3, 2, 90), (5, 64, 90)])
def test_reports_agree_with_brute_force(spark, monkeypatch, run, fan_in, long):
    monkeypatch.setattr(conversations, "RUN", run)
    monkeypatch.setattr(conversations, "FAN_IN", fan_in)
    rows = messages(2, long)
    got = sorted((tuple(r) for r in conversations.repair_damaged(table(spark, rows)).collect()), key=repr)
    assert got == by_hand(rows)


def test_repaired_messages_follow_the_pattern(spark):
    rows = [r for r in messages(3) if r[0] != 78]
    repair = conversations.Repair(table(spark, rows))
    made, left = {}, {}
    for r in repair.messages().collect():
        left.setdefault(r.conv_id, []).append((r.place, r.role, r.edit, r.turn))
    for conv, found in left.items():
        found.sort()
        made[conv] = "".join(role[0] for _, role, _, _ in found)
        assert re.fullmatch("s?(ua)+", made[conv])
        assert all((edit == "I") <= (turn is None) for _, _, edit, turn in found)
    assert {r.conv_id for r in repair.report().collect()} == {r[0] for r in rows}
    assert len(made) > 30


def test_empty_table(spark):
    assert conversations.repair_damaged(table(spark, [])).collect() == []
    assert conversations.Repair(table(spark, [])).messages().collect() == []
