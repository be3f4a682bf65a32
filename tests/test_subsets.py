"""The proven subset equals enumeration, and beats what is taken greedily."""

import random
import time
from itertools import combinations

from colloquy.operators import assembly


def enumerated(tokens, sets, budget, most):
    best = (0, 0, ())
    for size in range(1, most + 1):
        for picked in combinations(range(len(tokens)), size):
            spent, held = sum(tokens[i] for i in picked), 0
            for i in picked:
                held |= sets[i]
            if spent <= budget:
                best = min(best, (-held.bit_count(), spent, picked))
    return best[2]


def test_equals_enumeration_on_random_groups():
    r = random.Random(11)
    for case in range(500):
        n, most, turns = r.randint(0, 11), r.randint(1, 5), r.randint(1, 14)
        tokens = [r.choice((0, 5, 5, 10, 10, r.randint(1, 40))) for _ in range(n)]
        sets = [sum(1 << t for t in range(turns) if r.random() < 0.3) for _ in range(n)]
        budget = r.randint(1, 80)
        assert assembly._proven(tokens, sets, budget, most) == enumerated(tokens, sets, budget, most), (case, tokens, sets, budget, most)


def test_sixty_units_hold_a_planted_optimum(spark):
    # six units tile 60 turns exactly; 54 of better rank overlap each other
    r = random.Random(2)
    tiles = [(f"tile{i}", 100 + i, 100, [f"t{10 * i + j}" for j in range(10)]) for i in range(6)]
    decoys = [(f"decoy{i}", i, 95, [f"t{x}" for x in r.sample(range(60), 9)]) for i in range(54)]
    rows = [(1, *u) for u in tiles + decoys] + [(2, "alone", 1, 50, ["a"]), (3, "dear", 1, 5000, ["a"]), (4, "bare", 1, None, None)]
    units = spark.createDataFrame(rows, "query_id long, id string, rank int, tokens long, turn_keys array<string>")
    began = time.time()
    got = {(x.query_id, x.id) for x in assembly.proven_subset(units, 600, 6).collect()}
    assert got == {(1, f"tile{i}") for i in range(6)} | {(2, "alone")}
    assert time.time() - began < 120
    greedy = {x.id for x in assembly.best_subset(units.where("query_id = 1"), 600, 6).collect()}
    covered = lambda ids: len({t for u in rows if u[1] in ids for t in u[4] or ()})
    assert covered(greedy) < 60 == covered({i for q, i in got if q == 1})
    assert assembly.proven_subset(units.limit(0), 600, 6).count() == 0
