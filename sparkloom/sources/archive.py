"""Driver utilities: deterministic archives with a manifest, safe restore, and an atomic checkpoint store. Not part of any query."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import zipfile
from pathlib import Path, PurePosixPath

STAMP = (1980, 1, 1, 0, 0, 0)


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pack(folder: Path, target: Path, forbidden: tuple[str, ...] = (".git", "__pycache__")) -> str:
    """A zip of the folder's files in order of names with one fixed date, MANIFEST.json inside and a .sha256 beside it; returns its digest."""
    files = sorted(p for p in folder.rglob("*") if p.is_file())
    names = [p.relative_to(folder).as_posix() for p in files]
    if bad := [n for n in names if set(n.split("/")) & set(forbidden)]:
        raise ValueError(f"forbidden paths: {bad[:3]}")
    manifest = json.dumps({n: {"sha256": digest(p), "bytes": p.stat().st_size} for n, p in zip(names, files)}, sort_keys=True, indent=1)
    part = target.with_name(target.name + ".part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("MANIFEST.json", STAMP), manifest)
        for n, p in zip(names, files):
            with p.open("rb") as src, z.open(zipfile.ZipInfo(n, STAMP), "w") as out:
                shutil.copyfileobj(src, out)
    os.replace(part, target)
    target.with_name(target.name + ".sha256").write_text(f"{digest(target)}  {target.name}\n")
    return digest(target)


def _safe(name: str) -> bool:
    p = PurePosixPath(name)
    return not p.is_absolute() and ".." not in p.parts and "\\" not in name and bool(p.parts)


def restore(archive: Path, target: Path, sha256: str | None = None) -> list[str]:
    """Unpacks a zip or tar into a folder that must not exist: no absolute paths, no parents, no links; the digest is checked first."""
    if sha256 and digest(archive) != sha256:
        raise ValueError("the archive's digest differs")
    if target.exists():
        raise ValueError("the target exists")
    part = target.with_name(target.name + ".part")
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    names = []
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for i in z.infolist():
                if not _safe(i.filename) or (i.external_attr >> 16) & 0o170000 == 0o120000:
                    raise ValueError(f"unsafe entry: {i.filename}")
            z.extractall(part)
            names = z.namelist()
    else:
        with tarfile.open(archive) as t:
            for m in t.getmembers():
                if not _safe(m.name) or not (m.isfile() or m.isdir()):
                    raise ValueError(f"unsafe entry: {m.name}")
            t.extractall(part, filter="data")
            names = t.getnames()
    (part / "COMPLETE").write_text("")
    os.replace(part, target)
    return sorted(names)


class CheckpointStore:
    """Numbered folders that appear whole: written aside, marked COMPLETE, renamed; latest.json points at the last; old ones go."""

    def __init__(self, root: Path, keep: int = 3):
        self.root, self.keep = root, keep
        root.mkdir(parents=True, exist_ok=True)

    def save(self, step: int, files: dict[str, bytes]) -> Path:
        target, part = self.root / f"step-{step:08d}", self.root / f".step-{step:08d}.part"
        shutil.rmtree(part, ignore_errors=True)
        part.mkdir()
        for name, data in files.items():
            if not _safe(name):
                raise ValueError(f"unsafe name: {name}")
            (part / name).write_bytes(data)
        (part / "COMPLETE").write_text("")
        shutil.rmtree(target, ignore_errors=True)
        os.replace(part, target)
        aside = self.root / "latest.json.part"
        aside.write_text(json.dumps({"step": step, "path": target.name}))
        os.replace(aside, self.root / "latest.json")
        for old in self.complete()[: -self.keep]:
            shutil.rmtree(old)
        return target

    def complete(self) -> list[Path]:
        return sorted(p for p in self.root.glob("step-*") if (p / "COMPLETE").exists())

    def latest(self) -> Path | None:
        done = self.complete()
        return done[-1] if done else None


def stage(source: str, target: str, dry_run: bool = False, force: bool = False) -> list[str]:
    """Copies a reviewed local file or folder into target and names what is there then; a dry run only names what would be. A target that holds something is refused
    without force. Nothing is fetched from anywhere."""
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    if os.path.isdir(source):
        names = sorted(os.path.relpath(f"{d}/{n}", source) for d, _, own in os.walk(source) for n in own)
    else:
        names = [os.path.basename(source)]
    if dry_run:
        return names
    if os.path.isdir(target) and os.listdir(target) and not force:
        raise FileExistsError(f"{target} holds something already")
    for name in names:
        to = os.path.join(target, name)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        shutil.copy2(os.path.join(source, name) if os.path.isdir(source) else source, to)
    return names
