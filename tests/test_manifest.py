"""Many files that grow: offsets of bounded size, and every byte once."""

import json
import os
import random

import pytest

from runloom.sources import manifest, transcripts


def grow(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def lines_between(m, start, end):
    return [raw.decode() for p in transcripts.pieces(m.between(start, end), 50) for _, _, _, _, raw, _ in transcripts._read_pieces(p)]


@pytest.mark.parametrize("most", [0, 40])
@pytest.mark.parametrize("seed", range(3))
def test_every_line_once_over_restarts(tmp_path, seed, most):
    rng, want, got, at = random.Random(seed), [], [], 0
    folder, src = str(tmp_path / "m"), str(tmp_path / "in")
    m = manifest.Manifest(folder, src, most)
    for i in range(40):
        for _ in range(rng.randrange(4)):
            line = f"line {i} {rng.random()}"
            grow(f"{src}/{rng.randrange(3)}/{rng.randrange(6)}.jsonl", line + "\n")
            want.append(line)
        if rng.random() < 0.3:
            m = manifest.Manifest(folder, src, most)  # a restart
        now = m.advance()
        if rng.random() < 0.7:  # else the batch comes later, or again
            got += lines_between(m, at, now)
            at = now
    while (now := m.advance()) > at:
        got, at = got + lines_between(m, at, now), now
    assert sorted(got) == sorted(want)


def test_a_file_that_grows_during_the_listing_is_not_lost(tmp_path, monkeypatch):
    """Listed early, then appended to, while a file listed later moves the newest time on."""
    src = str(tmp_path / "in")
    grow(f"{src}/a.jsonl", "one\n")
    grow(f"{src}/b.jsonl", "two\n")
    listed = manifest.changed_files

    def slow(path, since):
        for found in sorted(listed(path, since)):
            yield found
            if found[0].endswith("a.jsonl") and not done:
                done.append(1)
                grow(f"{src}/a.jsonl", "three\n")
                os.utime(f"{src}/b.jsonl", (found[2] + 30, found[2] + 30))

    done = []
    monkeypatch.setattr(manifest, "changed_files", slow)
    m = manifest.Manifest(str(tmp_path / "m"), src)
    first = m.advance()
    assert lines_between(m, 0, first) == ["one", "two"]
    assert lines_between(m, first, m.advance()) == ["three"]


def test_offsets_stay_small_and_old_files_are_not_looked_up(tmp_path):
    src, n = str(tmp_path / "in"), 20_000
    for i in range(n):
        grow(f"{src}/{i % 50}/{i}.jsonl", "x\n")
        os.utime(f"{src}/{i % 50}/{i}.jsonl", (1e9 + i, 1e9 + i))
    reader = transcripts.TranscriptSource({"path": src, "manifest": str(tmp_path / "m")}).streamReader(None)
    end = reader.latestOffset()
    assert len(json.dumps(end)) < 30 and sum(len(p.ranges) for p in reader.partitions(reader.initialOffset(), end)) == n
    grow(f"{src}/3/3.jsonl", "y\n")
    again = transcripts.TranscriptSource({"path": src, "manifest": str(tmp_path / "m")}).streamReader(None)
    looked = []
    known = manifest.Manifest._read
    again.files._read = lambda name: looked.append(name) or known(again.files, name)
    now = again.latestOffset()
    assert again.files.between(end["version"], now["version"]) == [(f"{src}/3/3.jsonl", 2, 4)]
    assert again.latestOffset() == now


def test_what_a_crash_left_undone_is_done_at_the_next_start(tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    grow(f"{src}/a.jsonl", "one\n")
    m = manifest.Manifest(str(tmp_path / "m"), src)
    monkeypatch.setattr(manifest.Manifest, "_know", lambda self, spans: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        m.advance()
    monkeypatch.undo()
    m = manifest.Manifest(str(tmp_path / "m"), src)
    assert m.advance() == 1 and lines_between(m, 0, 1) == ["one"]


def test_old_versions_are_forgotten(tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "KEPT", 2)
    src, m = str(tmp_path / "in"), manifest.Manifest(str(tmp_path / "m"), str(tmp_path / "in"))
    for i in range(5):
        grow(f"{src}/a.jsonl", f"{i}\n")
        m.forget(m.advance())
    assert lines_between(m, 3, 5) == ["3", "4"]
    with pytest.raises(FileNotFoundError):
        m.between(0, 5)
