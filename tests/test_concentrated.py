"""Windows that hold exactly three quarters of a chord's sound."""

import numpy as np

from tonelake.operators import chords


def test_three_quarters_are_exact():
    ticks = []
    for a in range(20, 60):
        for b in range(20, 60):
            for c in range(20, 60):
                if (a + b + c) % 3 == 0:
                    ticks.append([a, 0, (a + b + c) // 3, 0, b, 0, 0, c, 0, 0, 0, 0])
    ticks = np.array(ticks, float)
    share = ticks / ticks.sum(1)[:, None]
    summed = share[:, 0] + share[:, 4] + share[:, 7]
    assert (summed < 0.75).any()  # sums of shares miss the limit
    assert chords._ALL.concentrated(share, ticks)[:, chords.QUALITIES.index("")].all()
    ticks[:, 2] += 1
    share = ticks / ticks.sum(1)[:, None]
    assert not chords._ALL.concentrated(share, ticks)[:, chords.QUALITIES.index("")].any()
