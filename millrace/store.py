"""Sessions, their messages and datasets, in a small SQLite file on the driver."""

from __future__ import annotations

import sqlite3
import time
import uuid

SCHEMA = """
CREATE TABLE IF NOT EXISTS sessions (id TEXT PRIMARY KEY, title TEXT, created REAL);
CREATE TABLE IF NOT EXISTS messages (id INTEGER PRIMARY KEY, session TEXT, role TEXT, content TEXT, created REAL);
CREATE TABLE IF NOT EXISTS datasets (session TEXT, name TEXT, path TEXT, PRIMARY KEY (session, name));
"""


class SessionStore:
    def __init__(self, path: str):
        self.db = sqlite3.connect(path, timeout=10)
        self.db.executescript(SCHEMA)

    def create(self, title: str = "New session") -> str:
        key = uuid.uuid4().hex
        with self.db:
            self.db.execute("INSERT INTO sessions VALUES (?, ?, ?)", (key, title, time.time()))
        return key

    def get(self, key: str) -> dict | None:
        row = self.db.execute("SELECT id, title, created FROM sessions WHERE id = ?", (key,)).fetchone()
        return {"id": row[0], "title": row[1], "created": row[2], "datasets": self.datasets(key)} if row else None

    def set_title(self, key: str, title: str) -> None:
        with self.db:
            self.db.execute("UPDATE sessions SET title = ? WHERE id = ?", (title, key))

    def add_dataset(self, key: str, name: str, path: str) -> None:
        """Sets one dataset's path; the others stay."""
        with self.db:
            self.db.execute("INSERT INTO datasets VALUES (?, ?, ?) ON CONFLICT (session, name) DO UPDATE SET path = excluded.path", (key, name, path))

    def datasets(self, key: str) -> dict[str, str]:
        return dict(self.db.execute("SELECT name, path FROM datasets WHERE session = ? ORDER BY name", (key,)))

    def append(self, key: str, role: str, content: str) -> None:
        with self.db:
            self.db.execute("INSERT INTO messages (session, role, content, created) VALUES (?, ?, ?, ?)", (key, role, content, time.time()))

    def recent(self, key: str, n: int = 8) -> list[dict]:
        rows = self.db.execute("SELECT role, content FROM messages WHERE session = ? ORDER BY id DESC LIMIT ?", (key, n)).fetchall()
        return [{"role": r, "content": c} for r, c in reversed(rows)]

    def list(self) -> list[dict]:
        rows = self.db.execute(
            "SELECT s.id, s.title, s.created, (SELECT count(*) FROM messages m WHERE m.session = s.id), (SELECT group_concat(name) FROM datasets d WHERE d.session = s.id) FROM sessions s ORDER BY s.created DESC"
        )
        return [{"id": a, "title": b, "created": c, "messages": n, "datasets": d.split(",") if d else []} for a, b, c, n, d in rows]

    def delete(self, key: str) -> bool:
        with self.db:
            for t in ("messages", "datasets"):
                self.db.execute(f"DELETE FROM {t} WHERE session = ?", (key,))
            return self.db.execute("DELETE FROM sessions WHERE id = ?", (key,)).rowcount > 0
