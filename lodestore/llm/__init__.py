"""Operations of a training-data pipeline, one module each.

Conventions of every operator here. Inputs are DataFrames with an integer id column and a string text column
(``doc_id`` and ``text`` unless told otherwise). Only the columns named in a signature are read, so extra
columns, also such as carry the name of an output, neither change a result nor clash with it. A null text
counts as the empty text; a null id is an id like another (null comes first where ids are ordered). Repeated
rows stay repeated rows. An empty table gives an empty result of the same schema. No operator reads a prefix
or a sample of the rows unless its docstring names the sample and its bound.
"""
