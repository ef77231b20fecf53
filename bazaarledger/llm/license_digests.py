"""Digests of the canonical forms (``license_scan``) of entire licence texts, too long to ship: (SPDX identifier, hex)."""

from __future__ import annotations

DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30"),  # whole
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0be"),  # to the end of its terms
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dea"),  # whole
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a2360"),  # whole
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed"),  # whole
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede"),  # whole
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee0"),  # whole
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc"),  # whole
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2"),  # to the end of its terms
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624f"),  # whole
    ("GPL-2.0", "e1270b653c300290e7c039142bccb877"),  # to the end of its terms
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4d"),  # whole
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370"),  # to the end of its terms
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd"),  # whole
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443cc"),  # to the end of its terms
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b4"),  # whole
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d"),  # to the end of its terms
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a"),  # whole
    ("MPL-1.1", "af9120248ffd9feada62cb62d18d7104"),  # whole
    ("MPL-1.1", "745d77fc9a461881e2bac9d7c5a0e306"),  # without exhibits
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae"),  # whole
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6"),  # without exhibits
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf5"),  # notice of a file
]
