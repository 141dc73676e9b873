"""Readers of posts, assets, query strings, playlists and repository snapshots; writers of pages, feeds and indexes."""
