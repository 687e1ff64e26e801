"""Where the public vocabulary files are."""

from __future__ import annotations

import os


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file, in ``folder``, else where the public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
