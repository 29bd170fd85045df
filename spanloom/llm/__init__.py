"""Operations for preparing training text at scale.

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library working.
"""
