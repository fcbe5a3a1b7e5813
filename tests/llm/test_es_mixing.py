from heronry.llm import es_mixing as M

from ..differential import duck, rows


def test_query(spark, sf_dir):
    assert rows(M.op8_es_mixing(spark, sf_dir)) == duck(sf_dir, M.SQL)


def test_targets_are_met(spark):
    got = M.op8_es_mixing(spark, "/root/testdata/sf0.01").collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s in target:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)


def test_odd_rows(odd, none):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.size == 0)
    size = sum(r.size for r in got)
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - size) < 1e-6 * size
    assert M.mix(none).count() == 0 and M.mixed(odd).columns == odd.columns
