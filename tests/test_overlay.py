"""Unions and repairs of rings against hand-worked areas, and against a count of grid points."""

import random

import pytest

from tramline.functions.overlay import united


def area(polygons):
    ring = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2
    return sum(abs(ring(p[0])) - sum(abs(ring(h)) for h in p[1:]) for p in polygons)


def square(x, y, w, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def test_hand_worked_areas():
    one = square(0.0, 0.0, 4.0)
    assert united([one]) == [[one]] and united([one + one[:1]]) == [[one]]
    assert area(united([one, square(2.0, 2.0, 4.0)])) == 28 and len(united([one, square(2.0, 2.0, 4.0)])) == 1
    assert area(united([one, square(4.0, 1.0, 2.0)])) == 20 and len(united([one, square(4.0, 1.0, 2.0)])) == 1  # along an edge
    assert area(united([one, square(4.0, 4.0, 2.0)])) == 20 and len(united([one, square(4.0, 4.0, 2.0)])) == 2  # at a corner
    assert area(united([one, square(9.0, 9.0, 1.0)])) == 17 and len(united([one, square(9.0, 9.0, 1.0)])) == 2
    assert area(united([one, square(1.0, 1.0, 2.0)])) == 16 and united([one, one]) == united([one, square(1.0, 1.0, 2.0)])
    bow_tie = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    assert area(united([bow_tie])) == 8 and len(united([bow_tie])) == 2
    frame = united([square(0.0, 0.0, 10.0, 1.0), square(0.0, 9.0, 10.0, 1.0), square(0.0, 0.0, 1.0, 10.0), square(9.0, 0.0, 1.0, 10.0)])
    assert len(frame) == 1 and len(frame[0]) == 2 and area(frame) == 36 and sorted(frame[0][1]) == [(1.0, 1.0), (1.0, 9.0), (9.0, 1.0), (9.0, 9.0)]
    assert len(frame[0][0]) == 4  # corners on a straight line are gone
    spike = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 9.0), (2.0, 4.0), (0.0, 4.0)]
    assert area(united([spike])) == 16
    assert united([]) == [] and united([[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]) == [] and united([[(0.0, 0.0), (1.0, 1.0)]]) == []


def inside(p, ring):
    (x, y), hit = p, False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
            hit = not hit
    return hit


@pytest.mark.parametrize("seed", range(40))
def test_unions_hold_what_any_ring_holds(seed):
    rng = random.Random(seed)
    rings = [[(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(3, 6))] for _ in range(rng.randint(1, 3))]
    got = united(rings)
    for _ in range(200):
        p = (rng.uniform(-1, 7), rng.uniform(-1, 7))
        assert any(inside(p, poly[0]) and not any(inside(p, h) for h in poly[1:]) for poly in got) == any(inside(p, r) for r in rings)
    assert abs(area(united([r for poly in got for r in poly[:1]])) - sum(area([[p[0]]]) for p in got)) < 1e-6  # outlines do not overlap


def test_footprints_of_overlapping_rings(spark, tmp_path):
    from tramline.sources import citygml

    line = lambda ring: f"<gml:curveMember><gml:LineString><gml:posList>{' '.join(f'{x} {y} 3' for x, y in ring + ring[:1])}</gml:posList></gml:LineString></gml:curveMember>"
    rings = {"two": [square(0.0, 0.0, 4.0), square(2.0, 2.0, 4.0)], "bow": [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]], "ell": [[(0.0, 0.0), (10.0, 0.0), (10.0, 1.0), (1.0, 1.0), (1.0, 10.0), (0.0, 10.0)]]}
    body = "".join(f'<bldg:Building gml:id="{n}"><bldg:lod1TerrainIntersection><gml:MultiCurve>{"".join(map(line, rs))}</gml:MultiCurve></bldg:lod1TerrainIntersection></bldg:Building>' for n, rs in rings.items())
    (tmp_path / "t.xml").write_text(f'<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">{body}</core:CityModel>')
    got = {r.building_id: r for r in citygml.read_buildings(spark, str(tmp_path / "t.xml")).collect()}
    assert {n: r.area for n, r in got.items()} == {"two": 28.0, "bow": 8.0, "ell": 19.0}
    assert (got["ell"].x, got["ell"].ground) == (0.5, 3.0) and got["two"].footprint.startswith("MULTIPOLYGON (((") and got["bow"].footprint.count("((") == 2
