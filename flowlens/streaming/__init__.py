"""The scoring job over a folder that keeps receiving captures."""
