"""Conversation repair beside the trial of all edits, and beside a plain loop where there are too many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import DATA  # noqa: F401

from furrow.llm import conversations, registry

EMPTY = hashlib.sha256().hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(rows):
    """Conversations of (conv_id, turn, role, text) with nulls as one space, in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in found.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def trials(rows, found, most_inserts=2):
    """(cost, audit, lines) of every sequence of edits that gives a legal conversation."""
    done = [(0, "", [], "")]
    for (_, role, text), fault in zip(rows, found, strict=True):
        new = []
        for path in done:
            starts = [path]
            for _ in range(most_inserts):
                starts += [(c + 5, a + "I", [*ls, f"{r}:"], roles + r[0]) for c, a, ls, roles in starts[-(2 ** (len(starts).bit_length() - 1)) :] for r in ("user", "assistant")]
            for cost, audit, lines, roles in starts:
                new.append((cost + 2, audit + "D", lines, roles))
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    new += [(cost + more, audit + "K", [*lines, f"{role}:{text}"], roles + role[:1])] if role else []
                    new += [(cost + 1 + more, audit + "R", [*lines, f"{r}:{text}"], roles + r[0]) for r in ("user", "assistant")]
        done = [p for p in {(c, a, r): (c, a, ls, r) for c, a, ls, r in new}.values() if re.fullmatch(r"s?(ua)*u?", p[3])]
    for _ in range(most_inserts):
        done += [(c + 5, a + "I", [*ls, f"{r}:"], roles + r[0]) for c, a, ls, roles in done for r in ("user", "assistant")]
    return [(c, a, ls) for c, a, ls, roles in done if re.fullmatch(r"(s?(ua)+)?", roles)]


def loop(rows, found):
    """The cheapest edits by a plain loop over rows, which keeps the least of each state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    puts = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def more(paths):
        for _ in range(2):
            for s, (cost, audit, lines) in list(paths.items()):
                t, path = step[s, puts[s][0]], (cost + 5, audit + "I", (lines, f"{puts[s]}:"))
                if t not in paths or path[:2] < paths[t][:2]:
                    paths[t] = path
        return paths

    paths = {0: (0, "", None)}
    for (_, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for s, (cost, audit, lines) in more(paths).items():
            options = [(s, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (s, role[:1]) in step:
                    options.append((step[s, role[:1]], (cost + extra, audit + "K", (lines, f"{role}:{text}"))))
                options.append((step[s, puts[s][0]], (cost + 1 + extra, audit + "R", (lines, f"{puts[s]}:{text}"))))
            for t, path in options:
                if t not in new or path[:2] < new[t][:2]:
                    new[t] = path
        paths = new
    cost, audit, chain = min((p for s, p in more(paths).items() if s in (0, 3)), key=lambda p: p[:2])
    lines = []
    while chain:
        chain, line = chain
        lines.append(line)
    return cost, audit, lines[::-1]


def expected(rows, cheapest):
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, lines = cheapest(rows, found)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_beside_all_edits(spark):
    draw = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "Udo", None], ["Yes.", "No!", "Why?  \n", "and so", " ", None, "Yes.", "etc. ", "Go on."]
    rows = [(c, draw.choice([0, 1, 2, 3, None, -4]), draw.choice(roles), draw.choice(texts)) for c in range(90) for _ in range(draw.randint(1, 3))]
    found = {r.conv_id: plain(r) for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {c: expected(rs, lambda a, b: min(trials(a, b))) for c, rs in by_turn(rows).items()}


def test_query_beside_the_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    wanted = {c: (0,) * 6 + ("", EMPTY) for c, *_ in rows} | {c: expected(rs, loop) for c, rs in by_turn(left).items()}
    assert {r.conv_id: plain(r) for r in registry.QUERIES["op12_conversations"](spark, "/root/testdata/sf0.01").collect()} == wanted


@pytest.mark.parametrize(("chunk", "piece"), [(20_000, 1_000), (50, 7), (3, 1)])
def test_long_conversations_go_on_in_the_next_chunk(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    draw = random.Random(9)
    n = {1: 1200 if piece > 1 else 90, 2: 3, 3: 30, 4: 1, 5: 60}
    rows = [(c, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"Text {t % 50}.", f"text {t}", "", f"Text {t}!"])) for c, k in n.items() for t in range(k)]
    found = {r.conv_id: plain(r) for r in conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert found == {c: expected(rs, loop) for c, rs in by_turn(rows).items()}


def test_oddities(spark):
    long = "a word and more. " * 60_000
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, "", "Empty role."), (1, 1, "user", "Hi."), (2, 0, "user", long), (2, 1, "assistant", long + "x"), (2, 1, "assistant", long + "x"),
        (3, 5, "user", ""), (4, 1, "assistant", "Same turn."), (4, 1, "user", "Same turn."), (5, None, "user", "No turn."), (5, None, "assistant", "At all."), (6, -(2**40), "system", "é!"), (6, 2**40, "user", "?"),
    ]
    clashing = ("g", "k", "nth", "fault", "initial", "kind", "copy", "place", "edit")
    df = spark.createDataFrame([(*r, *["own"] * len(clashing)) for r in rows], SCHEMA + "".join(f", {c} string" for c in clashing))
    found = {r.conv_id: plain(r) for r in conversations.repair(df).collect()}
    assert found == {c: expected(rs, loop) for c, rs in by_turn(rows).items()}
    assert conversations.repair(df.limit(0)).count() == 0
    assert conversations.damage(df).count() > 0 and conversations.damage(df.limit(0)).count() == 0
    every = conversations.repair_all(df.filter("conv_id = 3"), df).collect()
    assert {r.conv_id for r in every} == {r[0] for r in rows} and {plain(r) for r in every if r.conv_id != 3} == {(0,) * 6 + ("", EMPTY)}


def test_repaired_rows_are_those_of_the_hash(spark):
    rows = conversations.damage(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    repairs = conversations.repair(rows)
    lines = defaultdict(list)
    for r in sorted(conversations.repaired_rows(rows, repairs).collect(), key=lambda r: (r.conv_id, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert (found := {r.conv_id: r.repaired_sha256 for r in repairs.collect()}) == {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in found}
