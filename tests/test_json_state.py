import json
import random

from motes.operators import manifest


def merged(base, patch):
    out = dict(base)
    for k, v in patch.items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flat(state):
    for k, v in state.items():
        if isinstance(v, dict) and v:
            yield from ((k, m, json.dumps(x, separators=(",", ":"))) for m, x in v.items())
        else:
            yield k, None, None if isinstance(v, dict) else json.dumps(v, separators=(",", ":"))


def test_patches_fold_one_level_deep(spark):
    rng = random.Random(4)

    def value(deep):
        if deep and rng.random() < .5:
            return {m: value(False) for m in rng.sample("pqr", rng.randint(0, 3))}
        return rng.choice([1, True, "x{", None, 2.5, [1, {"a": 2}]])
    rows, want = [(9, 0, "no json"), (9, 1, None), (9, 2, "[1]")], {}
    for image in range(25):
        state = {}
        for t in range(rng.randint(1, 7)):
            patch = {k: value(True) for k in rng.sample("abc", rng.randint(0, 3))}
            rows.append((image + 100, t, json.dumps(patch)))
            state = merged(state, patch)
        want[image + 100] = sorted(flat(state), key=str)
    rng.shuffle(rows)
    got = {}
    for r in manifest.folded_patches(spark.createDataFrame(rows, "image int, ts int, patch string").repartition(3), ["image"], "ts").collect():
        got.setdefault(r.image, []).append((r.name, r.member, r.value))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_json_answers(spark):
    a = [{"recommended_parameters": {"sigma": {"value": 1.5, "why": "x"}, "low": 2, "grid": {"x": 1}, "on": {"value": True}}},
         {"parameters": {"sigma": {"value": 3}}}, {"other": 1}, {"recommended_parameters": {}, "parameters": {"p": 1}}]
    rows = [(k, json.dumps(x)) for k, x in enumerate(a)] + [(10, "Blur sigma: 2"), (11, None), (12, "[1]")]
    got = manifest.json_parameters(spark.createDataFrame(rows, "id int, text string"), ["id"])
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, "grid", '{"x":1}'), (0, "low", "2"), (0, "on", "true"), (0, "sigma", "1.5"), (1, "sigma", '{"value":3}')]
