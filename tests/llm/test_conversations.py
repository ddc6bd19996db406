import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gatewatch.llm import conversations as C
from gatewatch.llm import grammar as G

WS = " \t\n\x0b\x0c\r"


def brute_script(seq):
    """The cheapest script of a symbol sequence, by trying them all."""
    best = None

    def go(k, state, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(seq):
            for n in range(3):
                if state in (0, 3) and not (state == 0 and n) and (best is None or (cost + 3 * n, audit + "I" * n) < best):
                    best = (cost + 3 * n, audit + "I" * n)
                state = G.NEXT[state][0]
            return
        x = seq[k]
        for n in range(3):
            c, t = cost + 3 * n, audit + "I" * n
            go(k + 1, state, c + 4, t + "D")
            if x:
                more = 3 if x > 4 else 0
                go(k + 1, G.NEXT[state][0], c + 3 + more, t + "R")
                if (G.INITIALS[(x - 1) % 4], state) in G.KEPT:
                    go(k + 1, G.KEPT[G.INITIALS[(x - 1) % 4], state], c + more, t + "K")
            state = G.NEXT[state][0]

    go(0, 0, 0, "")
    return best


def test_scripts_equal_brute_force():
    rng = random.Random(1)
    seqs = [tuple(rng.randrange(9) for _ in range(rng.randrange(7))) for _ in range(150)]
    grammar = G.Grammar(seqs)
    for s in seqs:
        want = brute_script(s)
        assert grammar.solve(s) == want
        a, b = sorted(rng.randrange(len(s) + 1) for _ in range(2))
        parts = [s[:a], s[a:b], s[b:]]
        own = G.Grammar(parts)
        cost, steps, tail = G.chain([own.matrix(p) for p in parts])
        assert (cost, "".join(own.audit(p, i, j) for p, (i, j) in zip(parts, steps)) + tail) == want


def test_grammar_spells_its_sequences():
    rng = random.Random(2)
    seqs = [tuple(rng.choice([2, 3, 2, 3, 0]) for _ in range(rng.randrange(60))) for _ in range(40)] + [(1,) * 9, (2,) * 8, ()]
    rules, left = G.re_pair(seqs)

    def spelled(x):
        return [x] if x < G.SYMBOLS else spelled(rules[x - G.SYMBOLS][0]) + spelled(rules[x - G.SYMBOLS][1])

    assert [tuple(y for x in s for y in spelled(x)) for s in left] == seqs
    pairs = [p for s in left for p in zip(s, s[1:])]
    assert len({p for p in pairs if p[0] != p[1]}) == sum(p[0] != p[1] for p in pairs)  # none is left twice
    assert len(G.re_pair([(2, 3) * 50_000])[0]) < 30


def vector_dp(turns):
    """Cheapest audit of turns (initial, must go, truncated), turn by turn."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(2):
            for s, (c, t) in list(best.items()):
                got = (c + 3, t + "I")
                n = G.NEXT[s][0]
                best[n] = min(best.get(n, got), got)
        return best

    for initial, gone, cut in turns:
        new = {}
        for s, (c, t) in inserted(dict(best)).items():
            ways = [(s, c + 4, t + "D")]
            if not gone:
                ways.append((G.NEXT[s][0], c + 3 + 3 * cut, t + "R"))
                if (initial, s) in G.KEPT:
                    ways.append((G.KEPT[initial, s], c + 3 * cut, t + "K"))
            for n, c2, t2 in ways:
                new[n] = min(new.get(n, (c2, t2)), (c2, t2))
        best = new
    last = [best[0]] if 0 in best else []
    full = inserted(dict(best))
    return min(last + [full[3]] if 3 in full else last)


def brute(rows):
    """The whole contract, conversation by conversation."""
    out, by = [], {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = by.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub("[.!?]", "", text)
        elif what == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        count, seen, turns = dict(blank=0, duplicate=0, truncated=0), set(), []
        for _, role, text in held:
            bare = text.strip(WS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        dated = [r[0] for r in held if r[0] is not None]
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        cost, audit = vector_dp(turns)
        kept = G.applied(audit, [r[1:] for r in held])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((str(conv), gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return sorted(out)


def got(df):
    found = C.digests(C.repair(C.damage(df))).collect()
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
                  for r in found)


def table(n, rng):
    texts = ["Yes.", "No!", "well", "", " \n", None, "one. two? three", "é.", "fine.\n "]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(9)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", "?", "", "\t"])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None, 3]), rng.choice(
                ["user", "assistant", "system", "tool", "", None, "User"] if rng.random() < 0.3 else ["user", "assistant"][turn % 2:][:1]), text))
    rows += rows[:7] * 3
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_rows,part_chars", [(4096, 1 << 20), (2, 1 << 20), (3, 12)])
def test_equals_brute_force(spark, part_rows, part_chars, monkeypatch):
    """In whole conversations, and cut into many parts."""
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    monkeypatch.setattr(C, "PART_CHARS", part_chars)
    rows = table(120, random.Random(part_rows))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("part", F.lit("own")).withColumn("gone", F.lit(True))
    assert got(df) == brute(rows)


def test_hot_conversation(spark):
    """One conversation holds most rows, many of them alike."""
    rng = random.Random(7)
    rows = [(7, k, ["user", "assistant"][k % 2], f"line {k}.") for k in range(6000)]
    rows += [(7, 10_000 + k // 3, "user", "same again") for k in range(6000)] + table(20, rng)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_no_rows_and_long_text(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y" * 3_000_000 + ".")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Why?", False), (1, 1, "user", "How?", False), (1, 2, "assistant", "So.", False),
            (2, 0, "user", "gone", True)]
    parts = C.repair(spark.createDataFrame(rows, SCHEMA + ", gone boolean")).orderBy("conv", "part").collect()
    turns = [(r.conv, t.role, t.text) for r in parts for t in r.repaired]
    # keeping both questions with an empty answer between costs less than a deletion
    assert turns == [(1, "user", "Why?"), (1, "assistant", ""), (1, "user", "How?"), (1, "assistant", "So.")]
    assert "".join(r.audit for r in parts if r.conv == 1) == "KIKK" and [r.cost for r in parts if r.conv == 2 and r.cost is not None] == [0]
