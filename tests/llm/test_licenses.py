import hashlib
import zipfile
from pathlib import Path

import duckdb
import pyspark
import pytest

from leafmill.llm.licenses import NOTICES, TEXTS, scan_licenses, scan_sql


def test_known_texts_in_other_dress(spark):
    mit = TEXTS["MIT"]
    dressed = "# The MIT License (MIT)\n\nCopyright (c) 2019-2021 Some One\nAll rights reserved.\n" + "\n".join("# " + x for x in mit.upper().replace(", ", ",\n").split("\n"))
    rows = [
        (1, mit),
        (2, dressed),
        (3, mit + "\nbut not this"),
        (4, TEXTS["Zlib"].replace("acknowledgment", "acknowledgement")),
        (5, "prose\n * Licensed under the Apache Licence, version 2.0\nReleased under the MIT License.\nmore\nReleased under the MIT License."),
        (6, None),
        (7, ""),
        (None, "This work is licensed under the GNU General Public License, version 3."),
        (8, " \n\t\n"),
        (8, "é É ß\n# #"),
        (9, "x" * 200000),
    ] + [(100 + i, t) for i, t in enumerate(TEXTS.values())]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license_id string")
    got = scan_licenses(df).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].license_id for i in (1, 2, 3, 4)] == ["MIT", "MIT", None, "Zlib"]
    assert [by_id[100 + i].license_id for i in range(len(TEXTS))] == list(TEXTS)
    assert (by_id[5].n_notices, by_id[5].notice_ids) == (3, "Apache-2.0,MIT")
    assert by_id[None].notice_ids == "GPL-3.0"
    assert by_id[6].canonical_sha256 == by_id[7].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[6].license_id is None and len(got) == len(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = con.execute(scan_sql("documents")).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert scan_licenses(df.limit(0)).count() == 0


def test_every_notice_is_found(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string")
    assert {r.doc_id: r.notice_ids for r in scan_licenses(df).collect()} == dict(enumerate(NOTICES.values()))


#: Licences that Debian systems have as files, by their identifiers.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause (University of California)",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no licence files here")
def test_long_licences_by_their_digests(spark):
    texts = [(Path("/usr/share/common-licenses") / f).read_text() for f in FILES]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, "Copyright 2020 Some One\n" + t.replace("license", "licence").replace("  ", " ").upper()) for i, t in enumerate(texts)]
    rows += [(200 + i, t[:-200]) for i, t in enumerate(texts)]
    got = {r.doc_id: r.license_id for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = list(FILES.values())
    assert [got[i] for i in range(len(names))] == names == [got[100 + i] for i in range(len(names))]
    assert all(got[200 + i] is None for i in range(len(names)))


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan_licenses(df).collect()
    return [r.license_id for r in sorted(found, key=lambda r: r.doc_id)]


def test_licences_of_libraries_by_their_digests(spark):
    jars = sorted((Path(pyspark.__file__).parent / "jars").glob("jakarta.annotation-api-*.jar"))
    if not jars:
        pytest.skip("no such library here")
    whole = zipfile.ZipFile(jars[0]).read("META-INF/LICENSE.md").decode()
    epl = whole.split("\n---\n")[0]
    assert scanned(spark, [epl, epl.upper().replace("LICENSE", "LICENCE"), whole, epl[:-200]]) == ["EPL-2.0", "EPL-2.0", None, None]


def test_licences_of_a_toolchain_by_their_digests(spark):
    folders = sorted(Path.home().glob(".rustup/toolchains/*/share/doc/rust/licenses"))
    names = ("OFL-1.1", "CC-BY-SA-4.0", "Unicode-3.0")
    if not folders or not all((folders[0] / f"{n}.txt").is_file() for n in names):
        pytest.skip("no licence files here")
    texts = [(folders[0] / f"{n}.txt").read_text() for n in names]
    font = "Copyright (c) 2010, Some One,\nwith Reserved Font Name Some.\n\nThis Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttps://scripts.sil.org/OFL\n\n-----\n" + texts[0]
    assert scanned(spark, [*texts, font, texts[1][:-300]]) == [*names, "OFL-1.1", None]


def test_terms_alone_are_the_licence(spark):
    file = Path("/usr/share/common-licenses/Apache-2.0")
    if not file.is_file():
        pytest.skip("no licence files here")
    assert scanned(spark, [file.read_text().split("APPENDIX")[0]]) == ["Apache-2.0 (without appendix)"]
