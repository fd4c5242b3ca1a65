"""The same operators on streams; every one has a batch twin that gives the same rows."""
