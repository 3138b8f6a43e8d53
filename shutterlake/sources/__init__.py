"""Where tables come from and go to: files, listings, the versioned store, exports."""
