"""The operators' definitions in plain Python, for small inputs."""

from __future__ import annotations


def pct(covered: int, population: int) -> float | None:
    return 100.0 * covered / population if population else None


def by_group(register, events):
    """``register``: (subject, group) pairs; ``events``: subjects."""
    reached = {s for s in events if s is not None}
    members: dict = {}
    for subject, group in set(register):
        members.setdefault(group, [])
        if subject is not None:
            members[group].append(subject)
    return {
        group: (len(subjects), sum(s in reached for s in subjects))
        for group, subjects in members.items()
    }


def grid(register, events):
    """``events``: (subject, period) pairs."""
    placed = {(s, p) for s, p in events if s is not None and p is not None}
    subjects = {s for s, _ in register}
    seen = [p for s, p in placed if s in subjects]
    if not seen:
        return {}
    return {
        (group, period): counts
        for period in range(min(seen), max(seen) + 1)
        for group, counts in by_group(register, [s for s, p in placed if p == period]).items()
    }
