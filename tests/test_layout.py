import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_outside_llm_needs_it():
    for path in [*(ROOT / "leadloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_layout.py":
            assert not re.search(r"^\s*(?:from|import) (?:leadloom\.llm|corpus_pipeline)", path.read_text(), re.M), path


def test_entry_works_without_llm(tmp_path):
    for name in ("leadloom", "__spark_entry__.py"):
        source, target = ROOT / name, tmp_path / name
        if source.is_dir():
            for f in source.rglob("*.py"):
                if "llm" not in f.parts:
                    (tmp_path / f.relative_to(ROOT)).parent.mkdir(parents=True, exist_ok=True)
                    (tmp_path / f.relative_to(ROOT)).write_text(f.read_text())
        else:
            target.write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_no_local_checkpoints():
    for path in (ROOT / "leadloom").rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text()
