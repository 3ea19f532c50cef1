"""The network sees every candidate whole."""

import random
import string

from foliant.llm import secret_scan


def key(n, seed=1, pool=string.ascii_letters + string.digits):
    r = random.Random(seed)
    return "".join(r.choice(pool) for _ in range(n))


def added(text):
    (_, every, _), = secret_scan.batch_spans([text], secret_scan.default_network())
    return [text[s:e] for s, k, e in every if k == "cnn"]


def test_long_runs_are_candidates():
    for n in (201, 342, 1600):
        assert added(f"Authorization: Bearer {key(n)} is set") == [key(n)]


def test_the_end_of_a_long_run_is_seen():
    run = "part-of-the-chapter-2-" * 5 + key(60)
    shown = secret_scan.windows(f"see {run} for", 4, 4 + len(run))
    assert len(shown) > 1 and sum(o.sum() for _, o in shown) >= len(run) and not shown[-1][1][-1]
    assert added(f"see {run} for") == [run]


def test_a_base_finding_inside_does_not_hide_a_key():
    token = key(12, 2) + "Z0123456789abcdefZ" + key(12, 3)
    assert added(f"Bearer {token} set") == [token]
    assert added("password=" + key(30)) == []
