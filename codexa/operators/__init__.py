"""DataFrame operators on editions, tracks, files, providers and plans."""
