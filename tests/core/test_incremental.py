"""The parse cache: unchanged files are not read again, changed ones cost their partition."""

import os

from quernstone.plans.code import Code
from quernstone.sources import incremental


def names(code):
    return {r.name for r in code.functions.where("is_definition").select("name").collect()}


def test_only_changed_files_are_read(spark, tmp_path):
    root, store = tmp_path / "src", f"file://{tmp_path}/store"
    root.mkdir()
    for k in range(6):
        (root / f"f{k}.c").write_text(f"int first{k}(int a) {{ return a; }}\n")
        os.utime(root / f"f{k}.c", (1_700_000_000 + k, 1_700_000_000 + k))
    code = Code.update(spark, [str(root)], store)
    assert names(code) == {f"first{k}" for k in range(6)}
    of = {p: [os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{tmp_path}/store/parsed/{p}") for f in fs] for p in os.listdir(tmp_path / "store/parsed") if p.startswith("part=")}
    # same length and time: its new content isn't looked at; another file changes, one goes, one comes
    (root / "f0.c").write_text("int other0(int a) { return a; }\n")
    os.utime(root / "f0.c", (1_700_000_000, 1_700_000_000))
    (root / "f3.c").write_text("int second3(int a) { return a + 1; }\n")
    (root / "f4.c").unlink()
    (root / "g.c").write_text("int fresh(void) { return 0; }\n")
    code = Code.update(spark, [str(root)], store)
    assert names(code) == {"first0", "first1", "first2", "second3", "first5", "fresh"}
    assert code.files.count() == 6 and {r.path for r in code.symbols.select("path").collect()} == {"f0.c", "f1.c", "f2.c", "f3.c", "f5.c", "g.c"}
    after = {p: [os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{tmp_path}/store/parsed/{p}") for f in fs] for p in of}
    assert sum(of[p] != after[p] for p in of) <= 2
    again = incremental.refresh(spark, [str(root)], store)
    assert again.count() == 6


def test_nothing_there(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/readme.txt").write_text("x")
    (tmp_path / "src/a.c").write_text("int a;\n")
    code = Code.update(spark, [str(tmp_path / "src")], f"file://{tmp_path}/store")
    assert code.files.count() == 1
