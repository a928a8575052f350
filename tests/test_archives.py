import gzip
import io
import tarfile
import zipfile

import pytest

from verdigraph.sources import archives


def test_formats(tmp_path):
    assert [archives.archive_format(h) for h in (b"PK\x03\x04..", b"\x1f\x8b", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"<xml")] == ["zip", "gz", "xz", "7z", "plain"]
    (tmp_path / "a.csv").write_text("{SimaPro 9}\n")
    (tmp_path / "b.xml").write_text('<ecoSpold xmlns="http://www.EcoInvent.org/EcoSpold01"/>')
    (tmp_path / "c.spold").write_text("")
    assert [archives.data_format(tmp_path / n) for n in ("a.csv", "b.xml", "c.spold")] == ["simapro", "ecospold1", "ecospold2"]
    assert archives.data_format(tmp_path) == "ecospold2"
    (tmp_path / "d" / "processes").mkdir(parents=True)
    assert archives.data_format(tmp_path / "d") == "ilcd" and archives.data_format(tmp_path / "d" / "processes") is None


def test_archives_unpack_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.spold", "1")
    folder = archives.extract(tmp_path / "z.zip")
    assert (folder / "in/x.spold").read_text() == "1" and archives.extract(tmp_path / "z.zip") == folder
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b"{x}"))
    assert (archives.extract(tmp_path / "t.csv.gz") / "t.csv").read_text() == "{x}"
    with tarfile.open(tmp_path / "u.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.spold")
        info.size = 1
        t.addfile(info, io.BytesIO(b"2"))
    assert (archives.extract(tmp_path / "u.tar.gz") / "y.spold").read_text() == "2"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out", "1")
    with pytest.raises(ValueError):
        archives.extract(tmp_path / "bad.zip")
    assert archives.extract(tmp_path / "u.tar.gz").is_dir()
