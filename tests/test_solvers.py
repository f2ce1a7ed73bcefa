"""Both kernels against brute force, clauses and each other."""

from itertools import combinations, product

import pytest

from chromaspan.operators.solvers import fixed_order, saturation


def brute(items, colours, conflicts, fixed):
    return any(all(x[i] != x[j] for i, j in conflicts) and all(x[i] == c for i, c in fixed) for x in product(range(colours), repeat=items))


@pytest.mark.parametrize("items", [0, 1, 2, 3, 4])
def test_every_conflict_system(items):
    pairs = list(combinations(range(items), 2))
    for bits in range(1 << len(pairs)):
        conflicts = [p for k, p in enumerate(pairs) if bits >> k & 1]
        for colours in (1, 2, 3):
            want = "witness" if brute(items, colours, conflicts, []) else "candidate_unsat"
            for kernel in (saturation, fixed_order):
                status, found, _, _ = kernel.search(items, colours, conflicts)
                assert status == want
                if found is not None:
                    assert all(found[i] != found[j] for i, j in conflicts)


def test_every_fixed_pattern():
    for bits in range(8):
        conflicts = [p for k, p in enumerate([(0, 1), (0, 2), (1, 2)]) if bits >> k & 1]
        for pattern in product([None, 0, 1, 2], repeat=3):
            fixed = [(i, c) for i, c in enumerate(pattern) if c is not None]
            want = "witness" if brute(3, 3, conflicts, fixed) else "candidate_unsat"
            for kernel in (saturation, fixed_order):
                assert kernel.search(3, 3, conflicts, fixed)[0] == want


def test_counters_and_limits():
    triangle = [(0, 1), (0, 2), (1, 2)]
    assert saturation.search(3, 3, triangle)[2:] == (4, 0)
    assert saturation.search(3, 2, triangle)[2:] == (3, 3)
    assert fixed_order.search(3, 3, triangle)[2:] == (3, 0)
    assert fixed_order.search(0, 1, [])[2:] == (1, 0)
    assert saturation.search(2, 1, [(0, 1)], [(0, 0), (1, 0)]) == ("candidate_unsat", None, 0, 0)
    for kernel in (saturation, fixed_order):
        assert kernel.search(3, 2, triangle, max_nodes=1)[0] == "unknown"


def test_kernels_share_no_code():
    import ast
    from pathlib import Path

    import chromaspan

    top = Path(chromaspan.__file__).parent
    for name in ("operators/solvers/saturation.py", "operators/solvers/fixed_order.py", "operators/verify.py"):
        for node in ast.walk(ast.parse((top / name).read_text())):
            if isinstance(node, ast.ImportFrom):
                assert not (node.module or "").split(".")[0] in {"solvers", "solve", "partitions", "saturation", "fixed_order"} and node.level == 0
