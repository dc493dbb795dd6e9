"""Structure repair and prefix trie against brute force."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skirmish.llm import prefix_trie as P
from skirmish.llm import structure_repair as S

SCHEMA = "conv_id long, turn long, role string, text string, pos long, chunk string, conv string"
WS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Conversation rows with extra columns of names that the code uses."""
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(r):
    """Sort key of a row (turn, role, text): null turns first."""
    return (r[0] is not None, r[0] or 0, r[1], sha(r[2]))


# ------------------------------------------------------------------ repair
def damage(rows):
    out = defaultdict(list)
    sp = lambda x: " " if x is None else str(x)
    for c, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        out[c] += []
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fate == 4:
            role = "user"
        out[c] += [(turn, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(x, key=order) for c, x in out.items()}


def forward(rows):
    """Least (cost, audit, lines) by a forward search that keeps the ASCII-least
    audit of each state: another way than the operator's backward vectors."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def settle(best):
        for _ in range(4):
            for q, (cost, audit, lines) in list(best.items()):
                for r in "ua":
                    if (q, r) in step:
                        new = (cost + 5, audit + "I", [*lines, f"{names[r]}:"])
                        t = step[q, r]
                        if t not in best or new[:2] < best[t][:2]:
                            best[t] = new
        return best

    best = settle({"0": (0, "", [])})
    seen = set()
    for _, role, text in rows:
        bare = text.strip(WS)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        nxt = {}

        def offer(q, value):
            if q not in nxt or value[:2] < nxt[q][:2]:  # noqa: B023
                nxt[q] = value  # noqa: B023

        for q, (cost, audit, lines) in best.items():
            offer(q, (cost + 2, audit + "D", lines))
            if fault in ("", "t"):
                extra = 5 if fault else 0
                if (q, role[:1]) in step:
                    offer(step[q, role[:1]], (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                for r in "ua":
                    if (q, r) in step:
                        offer(step[q, r], (cost + 1 + extra, audit + "R", [*lines, f"{names[r]}:{text}"]))
        best = settle(nxt)
    return min((best[q] for q in "0a" if q in best), key=lambda x: x[:2])


def brute_repair(rows):
    out = []
    for c, xs in damage(rows).items():
        seen, n = set(), {"b": 0, "d": 0, "t": 0}
        for _, role, text in xs:
            bare = text.strip(WS)
            f = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if f:
                n[f] += 1
        turns = {t for t, _, _ in xs if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(xs))
        cost, audit, lines = forward(xs)
        out.append((c, gaps, n["b"], n["d"], n["t"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def talk(seed, n=40):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "why", " \n", "", "So, what?", "well...", "é\x85.", "cut off ", "a" * 5000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant", "Ursa"]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 14))):
            alternate = ["user", "assistant"][t % 2]
            rows.append((c, None if rng.integers(15) == 0 else int(t + rng.integers(3) // 2), alternate if rng.integers(3) else roles[rng.integers(9)],
                         None if rng.integers(12) == 0 else f"{t} {texts[rng.integers(10)]}" if rng.integers(2) else texts[rng.integers(10)]))
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (900, 0, "tool", "no"), *rows[:3]]
    # a long conversation of many chunks
    rows += [(901, int(t), roles[rng.integers(9)], f"{rng.integers(300)} {texts[rng.integers(10)]}") for t in rng.permutation(700)]
    return rows


@pytest.mark.parametrize("seed,chunk", [(0, 256), (1, 3), (2, 16)])
def test_repair(spark, seed, chunk):
    rows = talk(seed)
    got = S.repair_conversations(frame(spark, rows), chunk)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(rows)


def test_repair_empty_and_dropped(spark):
    assert S.repair_conversations(frame(spark, []).limit(0)).count() == 0
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = S.repair_conversations(frame(spark, [(*gone, "user", "x.")])).collect()
    assert [tuple(x) for x in r] == [(gone[0], 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_fix_up_equals_a_fresh_run_and_stops_early():
    rng = np.random.default_rng(5)
    shorter = 0
    for _ in range(300):
        codes = "".join(rng.choice(list(S.CODES), int(rng.integers(1, 40))))
        front, total = S.vectors(codes, S.SPECULATIVE)
        new = tuple(int(x) for x in rng.permutation([0, 1, 3, 5]))
        f, t, ran = S.fixed_up(codes, S.SPECULATIVE, new, front[0], total)
        want, want_total = S.vectors(codes, new)
        assert (f, t) == (want[0], want_total)
        shorter += ran < len(codes)
    assert shorter > 100


# ------------------------------------------------------------------ trie
def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=order)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    out = []
    for k, m in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = sorted(c for c in m if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def chats(seed):
    rng = np.random.default_rng(seed)
    stock = [[(str(rng.choice(["user", "assistant"])), "t" * int(rng.integers(0, 5))) for _ in range(12)] for _ in range(3)]
    rows = []
    for c in [0, 1, 2, 5, 50, 99, 100, 101, 130, 199, 205, 250, 299, 777, *range(300, 330), -3, -150]:
        base = stock[rng.integers(3)][:int(rng.integers(1, 13))]
        for t, (role, text) in enumerate(base):
            rows.append((c, None if rng.integers(20) == 0 else t, role if rng.integers(9) else None, None if rng.integers(9) == 0 else text))
    rows += [(400, t % 9, "user", f"line {t}") for t in range(90)] + [(401, t % 9, "user", f"line {t}") for t in range(85)]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[1], (500, 0, "user", "only one"), (500, 0, "user", "only one")]
    return rows


@pytest.mark.parametrize("seed,block", [(0, 4), (1, 4), (2, 3), (3, 1)])
def test_trie(spark, seed, block):
    rows = chats(seed)
    got = P.prefix_trie(frame(spark, rows), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_trie_without_conversations(spark):
    assert P.prefix_trie(frame(spark, []).limit(0)).count() == 0
    assert P.prefix_trie(frame(spark, [(None, 0, "user", "x")])).count() == 0


def test_pieces_of_one_node_hash_like_the_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    ids = list(range(-20, 80))
    got = P.end_hashes(spark.createDataFrame([(1, 2, 3, c) for c in ids] + [(0, 0, 0, 5)], "depth long, xa long, xb long, conv_id long")).collect()
    assert {tuple(r)[:3]: r[3] for r in got} == {(1, 2, 3): sha(",".join(map(str, ids))), (0, 0, 0): sha("5")}
