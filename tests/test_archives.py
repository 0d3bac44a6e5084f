"""Archives are unpacked only if nothing in them leaves the folder, links or is damaged; settings can be overridden."""

import json
import stat
import zipfile

import pytest

from quillon.sources import readers


def archive(path, *entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, body, mode in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr = mode << 16
            z.writestr(info, body)
    return str(path)


FILE, LINK = stat.S_IFREG | 0o644, stat.S_IFLNK | 0o777


def test_a_sound_archive(tmp_path):
    names = readers.extract_zip(archive(tmp_path / "a.zip", ("x/a.txt", "one", FILE), ("b.txt", "two", FILE)), str(tmp_path / "out"))
    assert names == ["x/a.txt", "b.txt"] and (tmp_path / "out" / "x" / "a.txt").read_text() == "one"


@pytest.mark.parametrize("entry", [("../up.txt", "x", FILE), ("/abs.txt", "x", FILE), ("x/../../up.txt", "x", FILE), ("link", "/etc/passwd", LINK)])
def test_entries_that_leave_the_folder(tmp_path, entry):
    with pytest.raises(ValueError):
        readers.extract_zip(archive(tmp_path / "a.zip", ("ok.txt", "fine", FILE), entry), str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())


def test_a_damaged_archive(tmp_path):
    path = archive(tmp_path / "a.zip", ("a.txt", "content that is there " * 50, FILE))
    body = bytearray((tmp_path / "a.zip").read_bytes())
    at = bytes(body).index(b"content that") + 100
    body[at] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(bytes(body))
    with pytest.raises(ValueError):
        readers.extract_zip(path, str(tmp_path / "out"))


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 1, "epochs": 5}))
    assert readers.read_config(str(tmp_path / "c.json"), {"seed": 2}) == {"seed": 2, "epochs": 5}
