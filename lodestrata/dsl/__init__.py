"""The factor language: text to a tree, printing, extents and static checks."""
