import random
from collections import defaultdict

from thicket.llm.chat_quotes import link_quotes, parse

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    parsed = [parse(t) for *_, t in rows]
    first = {}
    for (c, turn, _, _), (_, own, _, _) in zip(rows, parsed):
        for k in own:
            if c is not None and turn is not None:
                first[c, k] = min(turn, first.get((c, k), turn))
    quotes = defaultdict(set)
    for (c, turn, _, _), (_, _, q, _) in zip(rows, parsed):
        if c is not None and turn is not None:
            quotes[c, turn] |= set(q)
    reply, linked = {}, {}
    for (c, turn), q in quotes.items():
        per = {}
        for k, level, n in q:
            o = first.get((c, k))
            if o is not None and o < turn:
                a, b = per.get(o, (99, 0))
                per[o] = min(a, level), b + n
        if per:
            reply[c, turn] = max(per, key=lambda o: (-per[o][0], per[o][1], o))
            linked[c, turn] = sum(b for _, b in per.values())
    out = []
    for (c, turn, role, _), (text, _, _, n) in zip(rows, parsed):
        root, depth = turn, 0
        while (c, root) in reply:
            root, depth = reply[c, root], depth + 1
        out.append((c, root, turn, role, reply.get((c, turn)), depth, n, linked.get((c, turn), 0), text))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parse():
    text, own, quotes, n = parse("Hi\n\nAnn wrote:\n> one\n> two\n>> deep\n\nbye")
    assert text == "Hi\n\nbye" and n == 3 and len(own) == 2
    assert sorted((level, k) for _, level, k in quotes) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    assert parse(None) == (None, [], [], 0) and parse("a > b\n")[0] == "a > b\n"


def test_threads(spark):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        said = []
        for turn in range(rng.randrange(1, 90 if c == 0 else 14)):
            mine = [f"line {c} {turn} {i} Alpha" if rng.random() < 0.9 else "Same words" for i in range(rng.randrange(1, 4))]
            body = list(mine)
            if said and rng.random() < 0.8:
                text = rng.choice(said[-4:])
                cut = [f"> {x}" if not x.startswith(">") else f">{x}" for x in text]
                body = ["X wrote:"] * (rng.random() < 0.5) + cut[: rng.randrange(1, len(cut) + 1)] + ["> unknown"] * (rng.random() < 0.2) + [""] + mine
            said.append(body)
            rows.append((c, turn, "user" if turn % 2 == 0 else None, "\n".join(body)))
    rows += [(50, 0, "user", None), (50, 1, "user", ""), (50, 2, "user", "> \n>"), (None, 1, "user", "> line 1 0 0 alpha"), (50, None, "a", "x"), (50, 3, "a", "> x"), rows[3], rows[40]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = link_quotes(df)
    want = brute(rows)
    assert got(out) == want
    assert sum(r[4] is not None for r in want) > 60
    place = {}
    for i, r in enumerate(out.collect()):
        place.setdefault((r.conv_id, r.turn), i)
    assert all(place[r[0], r[4]] < place[r[0], r[2]] for r in want if r[4] is not None)


def test_long_chain_and_empty(spark):
    rows = [(1, t, "u", f"word {t}" if t == 0 else f"> word {t - 1}\nword {t}") for t in range(200)]
    out = link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.thread, r.depth) for r in out] == [(0, t) for t in range(200)]
    assert link_quotes(spark.createDataFrame([], SCHEMA)).collect() == []
