"""Sets meet where sizes and places allow it, and no pair that is alike is left out."""

import random

from rowtide.llm import prefix_join


def crossing(spark, sets, percent):
    df = spark.createDataFrame(sets, "node string, component string, tokens array<long>")
    return {(r["a"], r["b"]) for r in prefix_join.crossing_pairs(df, percent).collect()}


def test_no_alike_pair_is_left_out(spark):
    rnd = random.Random(11)
    for percent in (50, 80, 85, 100):
        sets = []
        for i in range(240):
            base = range(1000 * (i % 5), 1000 * (i % 5) + rnd.choice((1, 3, 9, 20, 60, 150)))
            edits = rnd.sample(base, k=min(len(base) - 1, rnd.randrange(len(base) // 6 + 2)))
            more = [rnd.randrange(10**9) for _ in range(rnd.randrange(len(base) // 8 + 1))]
            tokens = [*sorted(set(base) - set(edits)), *more]
            rnd.shuffle(tokens)
            sets.append((f"n{i}", f"c{rnd.randrange(120)}", tokens))
        want = set()
        for i, (x, c, a) in enumerate(sets):
            for y, d, b in sets[:i]:
                both = len(set(a) & set(b))
                if c != d and 100 * both >= percent * (len(a) + len(b) - both):
                    want.add((min(x, y), max(x, y)))
        assert len(want) > 100
        assert want <= crossing(spark, sets, percent)


def test_sets_of_sizes_that_rule_each_other_out_do_not_meet(spark, monkeypatch):
    """100 sets in one component and 100 others know a token, at places that leave too little for both."""
    common = list(range(96))
    sets = [(f"a{i}", "a", [10**6 + i * 100 + k for k in range(8)] + common[:92]) for i in range(100)]
    sets += [(f"b{i}", f"b{i}", [10**7 + i * 100 + k for k in range(14)] + common[:96]) for i in range(100)]
    sets += [(f"z{i}", "z", common[92:96]) for i in range(150)]  # so that these tokens come last
    rows = {}

    def counted(df, label):
        out = stage(df, label)
        rows[label] = out.count()
        return out

    stage = prefix_join.stage
    monkeypatch.setattr(prefix_join, "stage", counted)
    assert crossing(spark, sets, 85) == set()
    assert rows["prefixes"] > 100 and rows["met"] == 0
