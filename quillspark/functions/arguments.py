"""Arguments of callers, checked before a plan is made of them (F16)."""

from __future__ import annotations

from collections.abc import Sequence

LARGEST = (1 << 53) - 1


def choice(value: str | None, name: str, allowed: Sequence[str], default: str) -> str:
    """One of ``allowed``; the default where nothing is given."""
    if value is None or value == "":
        return default
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}")
    return value


def limit(value: int | str | None, default: int = 12, most: int = 50) -> int:
    """A whole number from 1 to ``most``, in digits only where it is text."""
    if value is None or value == "":
        return default
    if isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, str) and value.isascii() and value.isdigit()) or not 1 <= int(value) <= most:
        raise ValueError(f"limit is 1 to {most}")
    return int(value)


def identifier(value: int | str) -> int:
    """A whole number from 1 to 2^53 - 1."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = 0.0
    if not number.is_integer() or not 1 <= number <= LARGEST:
        raise ValueError("an id is a whole number from 1")
    return int(number)


def required_text(value: str | None, name: str, most: int = 500) -> str:
    """Text of 1 to ``most`` characters, trimmed."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} is empty")
    return optional_text(value, name, most)


def optional_text(value: str | None, name: str = "text", most: int = 500) -> str:
    """Text of at most ``most`` characters, trimmed; empty where none is given."""
    if value is None:
        return ""
    if not isinstance(value, str) or len(value.strip()) > most:
        raise ValueError(f"{name} is longer than {most} characters")
    return value.strip()
