"""Licences: whole texts known by digest."""

from pathlib import Path

import pytest

from quire.llm import licenses

FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts are installed")
def test_whole_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (FOLDER / name).read_text().upper().replace("\n\n", "\n \n")) for i, name in enumerate(files)]
    docs = spark.createDataFrame([*rows, (99, rows[0][1] + " more")], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.licensed) for r in licenses.scan(docs).collect()}
    assert got == {i: (name, True) for i, name in enumerate(files.values())} | {99: (None, False)}
