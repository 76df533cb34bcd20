"""Where rows and placement metadata come from and go to."""
