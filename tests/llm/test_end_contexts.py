from collections import Counter

import numpy as np

from cairnlight.llm.pairs import cut_short, end_contexts


def test_contexts_share_no_slot():
    """Each of many ends has its own count, however many contexts there are."""
    n = 200_000
    contexts, ends = end_contexts([f"a{chr(97 + i % 26)}{'xyzuvwklmn'[i // 26 % 10]} {''.join(chr(97 + int(c)) for c in str(i))}" for i in range(n)])
    assert len(ends) == n
    counts = Counter(contexts[ends][:, 0].tolist())
    assert len(counts) == n and set(counts.values()) == {1}
    assert len(np.unique(contexts[ends][:, 4])) == n


def test_a_full_stop_does_not_end_a_text_by_rule():
    """Counts of what ends decide also behind a full stop; the stop is only evidence where no context is known."""
    lines = ["Rest the knee and then."]
    seen_often_never_end, seen_often_ends, unknown = [(50, 1)] * 5, [(50, 45)] * 5, [(1, 1)] * 5
    assert cut_short(lines, {}, seen_often_never_end) and not cut_short(lines, {}, seen_often_ends)
    assert not cut_short(lines, {}, unknown) and cut_short(["Rest the knee and then"], {}, unknown)
    assert not cut_short(lines, {}, None) and not cut_short([], {}, None)
