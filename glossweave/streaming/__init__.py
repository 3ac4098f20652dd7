"""The same counts over text that keeps coming."""
