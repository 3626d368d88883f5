"""Texts that operators must handle, whatever they are for."""

ODD = [None, "", " ", "one two three", "one two three", "a" * 30_000, "x\ty\n\nz  ", "naïve café 中文 😀 \x00", "<|endoftext|> 's 're 12 345", "word " * 6000]
