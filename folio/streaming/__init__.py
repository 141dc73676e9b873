"""The same expressions over a folder that is watched."""
