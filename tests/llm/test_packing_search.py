"""The local search of packing where best fit leaves many bins underfull."""

import numpy as np

from quillon.llm import packing


def test_local_search_goes_on_until_no_bin_can_give():
    limit = 2048
    lengths = np.random.Generator(np.random.PCG64(3)).integers(400, 1001, 5000)
    start = packing.best_fit(lengths, limit)
    out = packing.improve(start, lengths, limit)
    assert sorted(i for b in out for i in b) == list(range(len(lengths))) and all(sum(lengths[b]) <= limit for b in out)
    fill = [int(sum(lengths[b])) for b in out]
    least = -(-sum(fill) // limit)
    assert len(out) - least < 0.6 * (len(start) - least)
    if len(out) > least:  # brute force: no move, and no exchange of one or two for one, raises the sum of squares
        for g in np.argsort(fill)[:20]:
            mine = lengths[out[g]].tolist()
            give = {*mine, *(a + b for i, a in enumerate(mine) for b in mine[i + 1 :])}
            for b in range(len(out)):
                for m in (0, *lengths[out[b]].tolist()) if b != g else ():
                    assert not any(0 < n - m <= limit - fill[b] and fill[b] - fill[g] + n - m > 0 for n in give)
