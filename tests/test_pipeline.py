"""The whole model on a small grid against numpy, stage by stage."""

import numpy as np
import pytest

from terracell import fixed
from terracell.functions import curves
from terracell.plans import fixtures as fx
from terracell.plans import suitability as plan
from terracell.operators import focal

NX, NY = fx.NX, 12


@pytest.fixture(scope="module")
def cells(spark, sf):
    lines = fx.lines(spark, sf)
    done = plan.suitability(fx.grid(spark, sf), fx.built_up(spark, sf), lines, lines.where("seq % 3 = 0").select("parts"), weather=0.5)
    return {(r.ix, r.iy): r for r in done.collect()}


def layer(cells, name):
    return np.array([[np.nan if cells[x, y][name] is None else float(cells[x, y][name]) for x in range(NX)] for y in range(NY)])


def curve(c, v):
    """A curve in plain Python."""
    if v is None or np.isnan(v):
        return c.missing
    if (v < c.start) if c.start_closed else (v <= c.start):
        return c.before
    begin = c.start
    for p in c.pieces:
        if (v <= p.to) if p.closed else (v < p.to):
            return p.a + (p.b - p.a) * ((v - begin) / (p.to - begin)) ** p.power
        begin = p.to
    return c.after


def nearest(mask):
    y, x = np.nonzero(mask)
    yy, xx = np.indices(mask.shape)
    return np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(-1))


def blur(v, sigma):
    w = focal.gaussian_weights(sigma)
    r = len(w) // 2
    pad = np.pad(v, r, mode="edge")
    rows = sum(w[k] * pad[:, k : k + v.shape[1]] for k in range(len(w)))
    return sum(w[k] * rows[k : k + v.shape[0]] for k in range(len(w)))


def test_every_cell_once(cells):
    assert len(cells) == NX * NY


def test_distances(cells):
    assert np.allclose(layer(cells, "dist_water"), nearest(layer(cells, "water") > 0) * 10)
    assert np.allclose(layer(cells, "dist_urban"), nearest(layer(cells, "urban") > 0) * 10)


def test_weighted_score_and_exclusions(cells):
    for r in list(cells.values())[::37]:
        s = {
            "geology": fixed.GEOLOGY_SCORES[r.geology], "altitude": curve(curves.ALTITUDE, r.zs), "slope": curve(curves.SLOPE, r.slope),
            "terrain_roughness": curve(curves.ROUGHNESS, r.roughness), "twi": curve(curves.TWI, r.twi), "urban_proximity": curve(curves.URBAN, r.dist_urban),
            "dist_water": min(1.0, curve(curves.WATER, r.dist_water) * r.factor), "geology_contact": curve(curves.CONTACT, r.dist_contact),
        }
        for k, v in s.items():
            assert r[f"s_{k}"] == pytest.approx(v, abs=1e-9), k
        have = sum(w for k, w in fixed.WEIGHTS.items() if f"s_{k}" in r.asDict() and r[f"s_{k}"] is not None)
        mean = sum(w * r[f"s_{k}"] for k, w in fixed.WEIGHTS.items() if f"s_{k}" in r.asDict() and r[f"s_{k}"] is not None) / have
        assert r.raw == pytest.approx(max(0.0, min(1.0, mean * (0.5 + 0.5 * have))), abs=1e-9)
        hard = r.urban or r.water or r.z is None or r.geology in fixed.EXCLUDED_GEOLOGY or r.slope > 50 or r.zs < 100 or r.zs > 1400 or r.twi > 18 or r.dist_urban < 15
        assert r.excluded == hard


def test_final_score(cells):
    out, slope, z = layer(cells, "excluded") > 0, layer(cells, "slope"), layer(cells, "zs")
    score = np.where(out, 0.0, layer(cells, "raw") * np.minimum(1.0, nearest(out) / max(1, round(15 / 10))))
    spread = np.sqrt(np.maximum(blur(z * z, 25.0) - blur(z, 25.0) ** 2, 0.0))
    even = np.where(spread < 15, blur((slope < 8).astype(float), 25.0), 0.0)
    score = np.where(out, score, score * (1 - 0.15 * even))
    lime = np.array([[fixed.SUBSTRATES.get(cells[x, y].geology) == 1 for x in range(NX)] for y in range(NY)])
    drop = 0.4 * np.clip(layer(cells, "roughness") / 10, 0, 1) + 0.6 * np.clip((8 - layer(cells, "twi")) / 6, 0, 1)
    score = np.where(lime & (z < 700) & (slope > 10) & ~out, score * np.clip(1 - 0.5 * drop, 0.5, 1), score)
    weight = blur((~out).astype(float), 2.0)
    smooth = np.where(weight > 1e-10, blur(np.where(out, 0.0, score), 2.0) / np.maximum(weight, 1e-10), 0.0)
    want = np.where(out, 0.0, smooth * 0.7)
    assert np.allclose(layer(cells, "score"), want, atol=1e-9)
    assert (layer(cells, "class") == np.digitize(layer(cells, "score"), fixed.CLASS_LIMITS)).all()
