"""The folder that releases of the gazetteer are kept in."""

from __future__ import annotations

import http.client
import re
import shutil
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from ..plans.steps import TABLES

RELEASE = "v0.4.1"
_NAME = re.compile(r"gazetteer_release_(.+)")


class Cache:
    """A folder named in a one-line config file, with one sub-folder for each release."""

    def __init__(self, config: str | Path, default: str | Path) -> None:
        self.config, self.default = Path(config), Path(default)

    def folder(self) -> Path:
        if self.config.exists() and (text := self.config.read_text().strip()):
            return Path(text)
        return self.default

    def set_folder(self, path: str | Path | None) -> Path:
        """Remember a folder (None: the default) and return it."""
        chosen = Path(path).expanduser().resolve() if path is not None else self.default
        self.config.parent.mkdir(parents=True, exist_ok=True)
        self.config.write_text(f"{chosen}\n")
        return chosen

    def release_folder(self, release: str = RELEASE) -> Path:
        return self.folder() / f"gazetteer_release_{release}"

    def files(self) -> list[Path]:
        """Everything that is cached."""
        root = self.folder()
        return sorted(p for p in root.rglob("*") if p.is_file()) if root.exists() else []

    def tree(self) -> str:
        """The cached files, indented by folder."""
        root = self.folder()
        lines = [str(root)]
        for p in sorted(root.rglob("*")) if root.exists() else []:
            lines.append("  " * len(p.relative_to(root).parts) + p.name)
        return "\n".join(lines)

    def delete(self) -> None:
        shutil.rmtree(self.folder(), ignore_errors=True)

    def invalidate(self, release: str = RELEASE) -> bool:
        """Delete all releases if there are others than the wanted one; says whether it did."""
        root = self.folder()
        others = [p for p in root.glob("gazetteer_release_*") if (m := _NAME.fullmatch(p.name)) and m[1] != release]
        if others:
            self.delete()
        return bool(others)

    def fetch(
        self,
        provider: Callable[[str, Path], None],
        tables: str | list[str] = "todas",
        release: str = RELEASE,
    ) -> Path:
        """Get missing tables from a provider (name, target file); returns the release's folder."""
        names = list(TABLES) if tables == "todas" else [tables] if isinstance(tables, str) else list(tables)
        unknown = [n for n in names if n not in TABLES]
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(unknown)}; there are {', '.join(TABLES)}")
        self.invalidate(release)
        folder = self.release_folder(release)
        folder.mkdir(parents=True, exist_ok=True)
        failed = []
        for name in names:
            target = folder / f"{name}.parquet"
            if target.exists():
                continue
            try:
                provider(name, target)
            except OSError as e:
                failed.append(f"{name} ({e})")
        if failed:
            raise RuntimeError(f"not fetched: {'; '.join(failed)}")
        return folder


def directory_provider(source: str | Path) -> Callable[[str, Path], None]:
    """Copy tables from a local directory."""

    def get(name: str, target: Path) -> None:
        path = Path(source) / f"{name}.parquet"
        part = target.with_suffix(".part")
        (shutil.copytree if path.is_dir() else shutil.copy)(path, part)
        part.rename(target)

    return get


def http_provider(base: str, *, tries: int = 3, timeout: float = 60.0) -> Callable[[str, Path], None]:
    """Fetch ``{base}/{name}.parquet`` over HTTP.

    What an interrupted transfer has left is taken up where it ended, if the server can do so, and a
    table appears under its name only when it is whole.
    """

    def get(name: str, target: Path) -> None:
        part = target.with_suffix(".part")
        for attempt in range(1, tries + 1):
            have = part.stat().st_size if part.exists() else 0
            request = urllib.request.Request(f"{base.rstrip('/')}/{name}.parquet")
            if have:
                request.add_header("Range", f"bytes={have}-")
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    on = answer.status == 206
                    due = answer.headers.get("Content-Length")
                    with part.open("ab" if on else "wb") as f:
                        shutil.copyfileobj(answer, f, 1 << 20)
                if due is None or part.stat().st_size == int(due) + (have if on else 0):
                    part.rename(target)
                    return
            except urllib.error.HTTPError as e:
                if e.code != 416:  # the part is no beginning of the file: start anew
                    raise OSError(f"{name}: status {e.code}") from e
                part.unlink(missing_ok=True)
            except (OSError, http.client.HTTPException):
                if attempt == tries:
                    raise
        raise OSError(f"{name}: the transfer broke off {tries} times")

    return get
