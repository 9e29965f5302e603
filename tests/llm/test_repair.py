"""Conversation repair against a table of best suffixes, and against all audits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

from tidemark.llm import repair as R

DATA = "/root/testdata/sf0.001"
FORM = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, marks):
    """(cost, audit, text) by the best suffix after every row in every state."""
    due = {"": "u", "s": "u", "a": "u", "u": "a"}
    name = {"u": "user", "a": "assistant"}
    after = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", ("assistant:",)), "s": (10, "II", ("user:", "assistant:"))}
    put = lambda cost, letter, line, rest: (rest[0] + cost, letter + rest[1], ((line,) if line is not None else ()) + rest[2])
    for (_, _, role, text), mark in zip(reversed(rows), reversed(marks), strict=True):
        now = {}
        for state in after:
            found = [put(2, "D", None, after[state])]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                found.append(put(1 + more, "R", f"{name[due[state]]}:{text}", after[due[state]]))
                if role[:1] == due[state] or (state == "" and role[:1] == "s"):
                    found.append(put(more, "K", f"{role}:{text}", after[role[:1]]))
            now[state] = min(found)
        for _ in range(2):
            now = {s: min(now[s], put(5, "I", f"{name[due[s]]}:", now[due[s]])) for s in now}
        after = now
    return after[""]


def brute(rows, damaged=True):
    ids = {r[0] for r in rows}
    rows = damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(own)
        cost, audit, lines = best(own, marks)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _seg int, fault string")


def made_up(rng, convs, longest):
    rows = []
    for c in convs:
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "No!", "why?", "cut off", " \n", "", None, f"t{t}.", "end. \n"])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


def test_given_table(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in R.damaged_and_repaired(df).collect()), key=str) == brute(rows)
    assert R.damaged_and_repaired(df.limit(0)).count() == 0


def test_made_up_conversations(spark):
    rows = made_up(random.Random(1), [None, *range(60)], 12) + [(100, 3, "user", "x" * 300_000 + "."), (101, None, None, None)]
    want = brute(rows)
    for segment in (R.SEGMENT, 3):
        assert sorted((tuple(r) for r in R.damaged_and_repaired(table(spark, rows), segment).collect()), key=str) == want


def test_a_third_of_all_rows(spark):
    """A long conversation is dealt in segments; its end decides what its beginning costs."""
    rng = random.Random(2)
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(1500)]
    for _ in range(120):
        at = rng.randrange(len(rows))
        rows[at] = (1, at, rng.choice(["user", "system", "assistant"]), rng.choice(["", "open", "0.", f"{at}!"]))
    rows += made_up(rng, range(2, 150), 10)
    want = brute(rows, damaged=False)
    for segment in (64, 500):
        assert sorted((tuple(r) for r in R.summary(table(spark, rows), segment).collect()), key=str) == want


def test_edits(spark):
    rows = made_up(random.Random(3), range(30), 9)
    found = {}
    for r in sorted(R.repair(table(spark, rows), 4).collect(), key=lambda r: (r.conv_id, r.place)):
        found.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, digest in brute(rows, damaged=False):
        own = found.get(conv, [])
        assert "".join(r.edit for r in own) == audit
        kept = [r for r in own if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == digest
        assert FORM.fullmatch("".join(r.role[0] for r in kept))


def test_auction_against_all_audits():
    """Every audit of up to four rows and two insertions: the cheapest, of these the ASCII-least."""
    rng = random.Random(4)
    kinds = list(itertools.product("uas", (0, R.BLANK, R.TRUNCATED)))
    for _ in range(60):
        rows = [rng.choice(kinds) for _ in range(rng.randrange(5))]
        options = []
        for edits in itertools.product(*["DKR" if f != R.BLANK else "D" for _, f in rows]):
            for where in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(3)):
                audit, cost = "", 5 * len(where)
                for i in range(len(rows) + 1):
                    audit += "I" * where.count(i)
                    if i < len(rows):
                        audit += edits[i]
                        cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + 5 * (edits[i] != "D" and rows[i][1] == R.TRUNCATED)
                kept = iter(r for (r, _), e in zip(rows, edits, strict=True) if e != "D")
                pattern = "".join(next(kept) if e == "K" else next(kept) and "[ua]" if e == "R" else "[ua]" for e in audit if e != "D")
                n = sum(e != "D" for e in audit)
                forms = ["ua" * (n // 2)] * (n % 2 == 0) + ["s" + "ua" * (n // 2)] * (n % 2 == 1 and n > 1)
                if any(re.fullmatch(pattern, f) for f in forms):
                    options.append((cost, audit))
        arcs = [R.arcs_of(r, f) for r, f in rows]
        trace = list(R.Auction(arcs, R.FINISH).trace(R.NOTHING))
        walked = "".join(e for e, _, _ in trace)
        state = trace[-1][2] if trace else R.NOTHING
        walked += {R.NOTHING: "", R.ASSISTANT: "", R.USER: "I", R.SYSTEM: "II"}[state]
        assert walked == min(options)[1]
