"""Where units and rules come from and where reports go."""
