import hashlib
import itertools
import random
import re
import zlib

import pytest

from inkveil.llm import conversation_repair as R

SPACE = "[\\x20\\x09-\\x0D]"
DATA = "/root/testdata/sf0.01"


def cheapest(rows, costs):
    """(cost, audit, repaired) by trying everything: rows of (role, text, fault)."""
    best = {}

    def go(i, roles, cost, audit, out, inserted):
        word = "".join(r[:1] for r in roles)
        if best and cost > min(best)[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", word):
            best[cost, audit] = out
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, cost + costs.delete, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                more = costs.truncated if fault == "truncated" else 0
                go(i + 1, [*roles, role or "?"], cost + more, audit + "K", [*out, f"{role}:{text}"], 0)
                for name in ("user", "assistant"):
                    go(i + 1, [*roles, name], cost + more + costs.rerole, audit + "R", [*out, f"{name}:{text}"], 0)
        if inserted < 3 and len(roles) < len(rows) + 4:
            for name in ("user", "assistant"):
                go(i, [*roles, name], cost + costs.insert, audit + "I", [*out, f"{name}:"], inserted + 1)

    go(0, [], 0, "", [], 0)
    cost, audit = min(best)
    return cost, audit, best[cost, audit]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(SPACE, "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(table, damaged=True, costs=R.Costs()):
    """The report, a conversation at a time, with a plain table of states instead of a search."""
    word = lambda x: " " if x is None else str(x)
    convs = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = word(role), word(text)
        draw = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20 if damaged else 9
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, *_ in rows if t is not None}
        kinds = faults([r[1:] for r in rows])
        states = {0: (0, "", [])}
        for (_, role, text), fault in zip(rows, kinds, strict=True):
            nexts = {}
            for s, (cost, audit, lines) in states.items():
                more = costs.truncated if fault == "truncated" else 0
                steps = [(s, costs.delete, "D", [])]
                if fault not in ("blank", "duplicate"):
                    if (s, role[:1]) in R.FOLLOWS:
                        steps.append((R.FOLLOWS[s, role[:1]], more, "K", [f"{role}:{text}"]))
                    name = {"u": "user", "a": "assistant"}[R.EXPECTED[s]]
                    steps.append((R.FOLLOWS[s, name[0]], more + costs.rerole, "R", [f"{name}:{text}"]))
                for to, c, letter, line in steps:
                    made = (cost + c, audit + letter, lines + line)
                    nexts[to] = min(nexts.get(to, made), made, key=lambda m: m[:2])
            states = nexts
        # at the usual costs nothing is worth an insert: deleting its neighbour is cheaper
        cost, audit, lines = min((states[s] for s in (0, 3) if s in states), key=lambda m: m[:2])
        pairs = itertools.pairwise(r[1][:1] for r in rows)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(insert=1), R.Costs(2, 3, 2, 1), R.Costs(4, 9, 1, 0)])
def test_solutions_by_trying_everything(costs):
    dice = random.Random(5)
    for _ in range(60):
        rows = [(dice.choice(["user", "assistant", "system", "tool", ""]), "x", dice.choice(["", "", "truncated", "blank"])) for _ in range(dice.randint(0, 4))]
        letters = "".join(R._letter(r, f) for r, _, f in rows)
        found = R.Signature(letters, costs=costs).solve(0)
        made = R.replay([{"turn": 1, "role": r, "text": t} for r, t, _ in rows], letters, found.audit, 0)
        assert (found.cost, found.audit, [f"{t['role']}:{t['text']}" for t in made]) == cheapest(rows, costs)


def test_pieces_compose(spark, monkeypatch):
    """Conversations cut anywhere give what they give whole, with inserts too."""
    dice = random.Random(8)
    table = [(c, t, dice.choice(["user", "assistant", "system", "tool", "user", "assistant"]), dice.choice(["Yes.", "no", "", f"{t}.", f"{t}!"])) for c in range(12) for t in range(dice.randint(1, 40))]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    for costs in (R.Costs(), R.Costs(4, 9, 1, 0)):
        whole = rows_of(R.report(df, df, costs))
        monkeypatch.setattr(R, "PIECE_ROWS", 3)
        assert rows_of(R.report(df, df, costs)) == whole
        monkeypatch.undo()
    assert rows_of(R.report(df, df)) == plain(table, damaged=False)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(R.op11_conversation_repair(spark, DATA)) == plain(table)


def test_odd_rows(spark):
    table = [(None, None, None, None), (None, 3, "user", "Hi."), (1, 5, "user", "A." * 400_000), (1, 6, "assistant", "B!" * 400_000), (1, 7, "", "C."), (2, 2, "user", "Same."), (2, 2, "user", "Same."), (2, 9, "user", "Same."), (2, 9, "assistant", "Tie."), (3, None, "user", "\t"), (4, 0, "assistant", "Uno."), (5, 1, "system", "Be kind."), (5, -3, "user", "x.\x0b")]
    table += [(7, 4, "user", "Again?")] * 500
    df = spark.createDataFrame([(*r, "taken") for r in table], "conv_id long, turn long, role string, text string, audit string")
    assert rows_of(R.report(df, df)) == plain(table, damaged=False)
    assert rows_of(R.report(R.damage(df), df)) == plain(table)
    assert R.report(df.limit(0), df.limit(0)).collect() == []
    far = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert R.report(far, far).select("gaps", "audit").collect() == [(None, "KK")]
