"""Fact differencing over the whole lattice of states, against a brute-force version and hand-made cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from deedwork.operators import disclosure

H, X, N = "holds", "fails", "not_covered"
SAFE = disclosure.DisclosureRule(zeros_disclosive=False)
STRICT = disclosure.DisclosureRule()


def by_hand(cells, k, zeros, allowed, least=10):
    """Rounds of merging every small, else every empty allowed combination with the nearest ones that have rows."""
    shown, gone = list(range(k)), set()
    while shown:
        held, every = {}, {tuple(s[i] for i in shown) for s in allowed}
        for state, n in cells.items():
            key = tuple(state[i] for i in shown)
            held[key] = held.get(key, 0) + n
        found = set()
        for targets in ([s for s, n in held.items() if n < least], sorted(every - set(held)) if zeros else []):
            for s in targets:
                apart = [[i for i, a, b in zip(shown, s, t) if a != b] for t in held if t != s]
                near = min(map(len, apart), default=0)
                found |= {i for a in apart if len(a) == near for i in a}
            if found:
                break
        if not found:
            break
        gone |= found
        shown = [i for i in shown if i not in found]
    return gone


def told(spark, cells, k, rule=SAFE, groups=()):
    names = [f"f{i}" for i in range(k)]
    table = spark.createDataFrame([(*s, n) for s, n in cells.items()], ", ".join(f"{n} string" for n in names) + ", n long")
    possible = [(tuple(f"f{i}" for i in at), spark.createDataFrame(sorted(states), ", ".join(f"f{i} string" for i in at))) for at, states in groups]
    out = disclosure.differencing(table, names, rule, possible).collect()
    assert [r.fact for r in out] == names and all((r.status == "C") == (r["round"] is not None) for r in out)
    return {int(r.fact[1:]) for r in out if r.status == "C"}


BOTH = {(H,), (X,)}
PAIR = {(N, N), (H, X), (X, H)}
CASES = [
    # A small cell withholds the facts whose change merges it.
    ({(H, H, H): 3, (H, X, H): 30, (X, H, H): 30, (X, X, X): 37}, 3, SAFE, (), {0, 1}),
    # Without such a change, the facts in which it differs from the nearest.
    ({(H, H, H): 3, (H, X, X): 20, (X, H, X): 20, (X, X, H): 20, (X, X, X): 37}, 3, SAFE, (), {0, 1, 2}),
    # An empty cell counts where it is possible and zeros are disclosive.
    ({(H, H): 50, (X, X): 50}, 2, STRICT, [((0, 1), {(H, H), (X, X), (X, H)})], {0, 1}),
    ({(H, H): 50, (X, X): 50}, 2, SAFE, [((0, 1), {(H, H), (X, X), (X, H)})], set()),
    ({(H, H): 50, (X, X): 50}, 2, STRICT, [((0, 1), {(H, H), (X, X)})], set()),
    # Two changes away, and across groups of facts.
    ({(H, X): 50, (X, H): 50}, 2, STRICT, [((0, 1), PAIR)], {0, 1}),
    ({a + a: 40 for a in PAIR}, 4, STRICT, [((0, 1), PAIR), ((2, 3), PAIR)], {0, 1, 2, 3}),
    # Small cells are settled before empty ones.
    ({(H, H, H): 25, (H, H, X): 25, (X, X, H): 25, (X, X, X): 24, (X, H, X): 1}, 3, STRICT, [((0, 1), {(H, H), (X, X), (X, H)}), ((2,), BOTH)], {0, 1}),
    # 33 + 33 - 63 = 3: three facts whose pairs all differ by much.
    ({(H, H, H): 3, (H, X, H): 30, (X, H, H): 30, (X, X, X): 37}, 3, STRICT, [((0, 1, 2), {(H, H, H), (H, X, H), (X, H, H), (X, X, X)})], {0, 1}),
    ({(H, H, H): 30, (H, X, H): 30, (X, H, H): 30, (X, X, X): 37}, 3, SAFE, (), set()),
    ({(H,): 4}, 1, STRICT, [((0,), BOTH)], {0}),
    ({(H,): 4}, 1, SAFE, (), set()),
]


@pytest.mark.parametrize(("cells", "k", "rule", "groups", "want"), CASES)
def test_cases(spark, cells, k, rule, groups, want):
    assert told(spark, cells, k, rule, groups) == want
    allowed = [sum(parts, ()) for parts in itertools.product(*(sorted(s) for _, s in groups))] if groups else []
    assert by_hand(cells, k, rule.zeros_disclosive and bool(groups), allowed) == want


def test_no_order_of_the_facts_matters(spark):
    cells = {(H, H, H, X): 3, (H, X, H, X): 30, (X, H, H, H): 30, (X, X, X, H): 37, (X, X, H, X): 12}
    found = set()
    for order in [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)]:
        moved = {tuple(s[i] for i in order): n for s, n in cells.items()}
        found.add(frozenset("abcd"[order[i]] for i in told(spark, moved, 4)))
    assert found == {frozenset("b")}


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed, monkeypatch):
    monkeypatch.setattr(disclosure, "LEVEL_KEYS", [256, 3, 1][seed % 3])
    rng = random.Random(seed)
    k = rng.choice([3, 4, 5])
    states = list(itertools.product((H, X, N), repeat=k))
    cells = {s: rng.choice([2, 9, 15, 40]) if rng.random() < 0.3 else 60 for s in rng.sample(states, rng.randint(2, 12))}
    singles = [((i,), {(H,), (X,), (N,)}) for i in range(k)]
    zeros = seed % 2 == 0
    rule = STRICT if zeros else SAFE
    assert told(spark, cells, k, rule, singles) == by_hand(cells, k, zeros, states)


def test_possible_states_are_those_of_some_value(spark):
    a = F.col("a")
    facts = {"big": (None, a >= 10), "huge": (a >= 10, a >= 100), "known": (None, F.col("b").isNotNull())}
    ((names, allowed),) = disclosure.possible_states(spark, facts, {"a": ("int", (1, 10, 100, None)), "b": ("string", ("x", None))})
    assert names == ("big", "huge", "known")
    assert sorted(map(tuple, allowed.collect())) == sorted((b, h, k) for b, h in ((X, N), (H, X), (H, H)) for k in (H, X))
    with pytest.raises(ValueError):
        disclosure.possible_states(spark, facts, {c: ("int", tuple(range(300))) for c in "abcd"})
    assert [(n, sorted(r[0] for r in t.collect())) for n, t in disclosure.free_states(spark, facts)] == [(("big",), [X, H]), (("huge",), [X, H, N]), (("known",), [X, H])]
