"""Content quality of a page, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

# Signs of a challenge page.
CHALLENGES = ("captcha", "access denied", "just a moment", "verify you are human")


def quality_score(markdown: Column, html: Column, status: Column, title: Column) -> Column:
    """HTM18: up to 0.65 for characters other than white space, 0.1 each for status and title,
    0.05 each for a heading and a blank line, minus 0.6 for a challenge; cut to 0..1."""
    chars = F.length(F.regexp_replace(markdown, r"(?U)\s", ""))
    yes = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    page = ascii_lower(F.concat_ws("\n", F.coalesce(html, F.lit("")), markdown))
    challenge = F.greatest(*[page.contains(c) for c in CHALLENGES])
    score = (
        F.least(chars / F.lit(2000.0), F.lit(0.65))
        + yes((status >= 200) & (status < 400), 0.1)
        + yes(F.regexp_replace(title, r"(?U)\s", "") != "", 0.1)
        + yes(markdown.startswith("#") | markdown.contains("\n#"), 0.05)
        + yes(markdown.contains("\n\n"), 0.05)
        - yes(challenge, 0.6)
    )
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
