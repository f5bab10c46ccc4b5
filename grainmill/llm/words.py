"""The words, hashes and windows of grainmill.functions.hashed."""

from grainmill.functions.hashed import LOWER, SPACE, Scan, mix, shingles, windows  # noqa: F401
