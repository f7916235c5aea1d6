"""Magnified references."""

import struct

from netloom.sources import gds
from tests.test_sources import name, real8, record, xy


def test_magnification_goes_down_the_levels(spark, tmp_path):
    def ref(cell, *at):
        return record(gds.SREF) + record(gds.SNAME, name(cell)) + record(gds.STRANS, b"\0\0") + record(gds.MAG, real8(2.0)) + xy(at) + record(gds.ENDEL)

    def cell(title, body):
        return record(gds.STRNAME, name(title)) + body + record(gds.ENDSTR)

    box = record(gds.BOUNDARY) + record(gds.LAYER, struct.pack(">h", 1)) + record(gds.DATATYPE, struct.pack(">h", 0)) + xy((0, 0), (1000, 0), (1000, 1000), (0, 0)) + record(gds.ENDEL)
    label = record(gds.TEXT) + record(gds.LAYER, struct.pack(">h", 1)) + record(gds.TEXTTYPE, struct.pack(">h", 5)) + xy((500, 250)) + record(gds.STRING, name("A")) + record(gds.ENDEL)
    units = record(gds.UNITS, real8(0.001) + real8(1e-9))
    (tmp_path / "m.gds").write_bytes(units + cell("leaf", box + label) + cell("mid", ref("leaf", 3000, 0)) + cell("whole", ref("mid", 10000, 0)))
    rows = gds.flatten(gds.read_elements(spark, str(tmp_path / "m.gds"))).collect()
    assert [(r.x, r.y) for r in rows if r.kind == "label"] == [(18.0, 1.0)]
    rings = [[(round(p.x, 6), round(p.y, 6)) for p in r.ring] for r in rows if r.kind == "boundary"]
    assert rings == [[(16.0, 0.0), (20.0, 0.0), (20.0, 4.0)]]
